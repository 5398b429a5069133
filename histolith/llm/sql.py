"""SQL for the queries of this package, for an independent engine (DuckDB), over the same whole tables."""

from __future__ import annotations

from histolith.llm import authored as A


def _clean(c: str) -> str:
    return rf"regexp_replace(regexp_replace(replace(trim({c}, ' '), '\', '/'), '/+', '/', 'g'), '^\./', '')"


def _words(c: str) -> str:
    joined = rf"regexp_replace(regexp_replace(nfc_normalize({c}), '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '(\p{{L}})-[ \t]*\r?\n[ \t>]*(\p{{L}})', '\1\2', 'g')"
    return rf"regexp_extract_all(lower({joined}), '[\p{{L}}\p{{M}}\p{{N}}]+')"


_TERMS = f"""
f AS (SELECT sha, {_clean('f')} AS term FROM (SELECT sha, unnest(files) AS f FROM (SELECT DISTINCT ON (sha) sha, files FROM commits)) WHERE f IS NOT NULL),
c AS (SELECT DISTINCT ON (cand_id) * FROM candidates),
k AS (SELECT cand_id, lower(trim(t)) AS term FROM (SELECT cand_id, unnest(topic_tokens) AS t FROM c) WHERE trim(t) <> ''),
d AS (SELECT cand_id, t AS term FROM (SELECT cand_id, unnest(top_dirs) AS t FROM c) WHERE t IS NOT NULL),
x AS (SELECT 'file' AS kind, term, count(*) AS occurrences, count(DISTINCT sha) AS records, (SELECT count(DISTINCT sha) FROM commits) AS total FROM f GROUP BY term
 UNION ALL SELECT 'token', term, count(*), count(DISTINCT cand_id), (SELECT count(*) FROM c) FROM k GROUP BY term
 UNION ALL SELECT 'dir', term, count(*), count(DISTINCT cand_id), (SELECT count(*) FROM c) FROM d GROUP BY term),
m AS (SELECT *, CASE WHEN records = 1 THEN 'rare' WHEN records > 3 AND records * 50 > total THEN 'common' END AS mark FROM x)"""

_WORDS = """
cw AS (SELECT sha AS record_key, unnest(regexp_extract_all(lower(subject), '[a-z][a-z0-9]{2,}')) AS term FROM (SELECT DISTINCT ON (sha) sha, subject FROM commits)),
kw AS (SELECT cand_id AS record_key, lower(trim(t)) AS term FROM (SELECT cand_id, unnest(topic_tokens) AS t FROM (SELECT DISTINCT ON (cand_id) * FROM candidates)) WHERE trim(t) <> ''),
w AS (SELECT 'commit' AS kind, record_key, term, count(*) AS tf FROM cw GROUP BY ALL UNION ALL SELECT 'candidate', record_key, term, count(*) FROM kw GROUP BY ALL),
d AS (SELECT kind, term, count(*) AS df FROM w GROUP BY kind, term)"""

_SETS = f"""
w AS (SELECT DISTINCT 'commit' AS kind, sha AS k, {_clean('f')} AS term FROM (SELECT sha, unnest(files) AS f FROM commits) WHERE f IS NOT NULL
 UNION SELECT 'candidate', cand_id, lower(trim(t)) FROM (SELECT cand_id, unnest(topic_tokens) AS t FROM candidates) WHERE trim(t) <> ''),
n AS (SELECT kind, k, count(*) AS n, string_agg(term, '|' ORDER BY term) AS s FROM w GROUP BY kind, k HAVING count(*) >= 4),
b AS (SELECT w.*, n FROM w JOIN n USING (kind, k)),
p AS (SELECT a.kind, a.k AS key_a, z.k AS key_b, any_value(a.n) AS na, any_value(z.n) AS nb, count(*) AS o FROM b a JOIN b z ON a.kind = z.kind AND a.term = z.term AND a.k < z.k GROUP BY ALL),
r AS (SELECT kind, key_a, key_b FROM p WHERE o * 10 >= 6 * (na + nb - o))"""


def _hand_rules() -> str:
    """Names and lines that show a file isn't hand-written (siblings decide nothing on the test tables)."""
    any_of = lambda c, *patterns: " OR ".join(f"regexp_matches({c}, '{_quoted(p)}')" for p in patterns)
    base, segment = "regexp_extract(path, '[^/]*$')", "x"
    folder = "regexp_replace(path, '/?[^/]*$', '')"
    hashed = A.HASHED_FILES.replace("(?=[0-9a-f]*[0-9])", "")
    name = f"{any_of(base, A.LOCK_FILES, A.GENERATED_FILES, A.MINIFIED_FILES)} OR (regexp_matches({base}, '{hashed}') AND regexp_matches(regexp_extract({base}, '{hashed}'), '[0-9]'))"
    dirs = f"len(list_filter(string_split({folder}, '/'), lambda {segment}: {any_of(segment, A.VENDOR_DIRS, A.GENERATED_DIRS, A.BUILT_DIRS)})) > 0"
    nested = " OR ".join(f"regexp_matches({folder}, '{_quoted(p.removesuffix('$'))}(/|$)')" for p in (A.BUILT_PAIRS, A.VERSIONED_COPY))
    return f"{name} OR {dirs} OR {nested}"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _said(c: str) -> str:
    gaps, marks = f"length({c}) - length(translate({c}, ' ' || chr(9), ''))", f"length({c}) - length(translate({c}, ';,{{}}()=.:&|?!+', ''))"
    dense = f"(length({c}) >= 160 AND ({gaps}) * 50 < length({c}) AND ({marks}) * 6 > length({c}))"
    note = f"regexp_matches({c}, '{_quoted(A.COMMENT)}') AND (regexp_matches({c}, '{_quoted(A.GENERATED_LINE)}') OR regexp_matches({c}, '{_quoted(A.VENDORED_LINE)}'))"
    blob = f"length({c}) >= 60 AND (regexp_matches({c}, '{_quoted(A.HEX_LINE)}') OR regexp_matches({c}, '{_quoted(A.BASE64_LINE)}'))"
    return f"({note}) OR {dense} OR ({blob})"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_frequencies": f"WITH {_TERMS} SELECT kind, term, occurrences, records, total, mark FROM m",
        "p1_found": f"WITH {_TERMS} SELECT kind, term, mark FROM m WHERE mark IS NOT NULL",
        "p2_found": f"""
WITH c AS (SELECT DISTINCT repo, sha, {_clean('f')} AS path FROM (SELECT repo, sha, unnest(files) AS f FROM commits) WHERE f IS NOT NULL),
s AS (SELECT repo, sha FROM c GROUP BY repo, sha HAVING count(*) <= 30),
b AS (SELECT c.* FROM c JOIN s USING (repo, sha)),
n AS (SELECT repo, count(DISTINCT sha) AS n FROM s GROUP BY repo),
m AS (SELECT repo, path, count(*) AS n FROM b GROUP BY repo, path),
p AS (SELECT a.repo, a.path AS path_a, z.path AS path_b, count(*) AS n_ab FROM b a JOIN b z ON a.repo = z.repo AND a.sha = z.sha AND a.path < z.path GROUP BY ALL HAVING count(*) >= 5)
SELECT p.repo, path_a, path_b FROM p JOIN n ON n.repo = p.repo JOIN m ma ON ma.repo = p.repo AND ma.path = path_a JOIN m mb ON mb.repo = p.repo AND mb.path = path_b
WHERE n_ab * n.n >= 3 * ma.n * mb.n""",
        "p3_scores": f"""WITH {_WORDS}, l AS (SELECT kind, record_key, sum(tf) AS length FROM w GROUP BY ALL),
t AS (SELECT 'commit' AS kind, count(DISTINCT sha) AS n FROM commits UNION ALL SELECT 'candidate', count(DISTINCT cand_id) FROM candidates)
SELECT kind, record_key, term, tf, df, round(tf / length * (ln((1 + n) / (1 + df)) + 1), 9) AS score FROM w JOIN d USING (kind, term) JOIN l USING (kind, record_key) JOIN t USING (kind)""",
        "p3_found": f"""WITH {_WORDS}, r AS (SELECT w.*, df, row_number() OVER (PARTITION BY kind, record_key ORDER BY df, term) AS rn FROM w JOIN d USING (kind, term) WHERE df >= 2)
SELECT kind, record_key, term FROM r WHERE rn = 1 AND df <= 5""",
        "p4_found": f"WITH {_SETS} SELECT kind, key_a, key_b FROM r",
        "p4_links": f"""WITH {_SETS}, e AS (SELECT kind, key_a AS k FROM r UNION ALL SELECT kind, key_b FROM r),
g AS (SELECT kind, k, min(k) OVER (PARTITION BY kind, s) AS class_key FROM n)
SELECT kind, k AS record_key, class_key, count(*) AS links FROM e JOIN g USING (kind, k) GROUP BY ALL""",
        "p5_found": """
WITH RECURSIVE e AS (SELECT DISTINCT c.cand_id, m.sha FROM (SELECT cand_id, lower(trim(u)) AS u FROM (SELECT cand_id, unnest(commits) AS u FROM candidates) WHERE u IS NOT NULL) c
 JOIN (SELECT DISTINCT sha FROM commits) m ON length(u) >= 8 AND left(m.sha, 8) = left(u, 8) AND starts_with(m.sha, u)),
l AS (SELECT DISTINCT a.sha AS s, b.sha AS t FROM e a JOIN e b USING (cand_id) WHERE a.sha <> b.sha),
r AS (SELECT s, s AS t FROM l UNION SELECT r.s, l.t FROM r JOIN l ON l.s = r.t)
SELECT s AS sha, min(t) AS group_sha FROM r GROUP BY s""",
        "p7_found": f"""
WITH r AS (SELECT sha, min(repo) AS repo FROM commits GROUP BY sha),
p AS (SELECT DISTINCT repo, {_clean('path')} AS path FROM changes JOIN r USING (sha) WHERE path IS NOT NULL),
s AS (SELECT DISTINCT repo, {_clean('path')} AS path FROM diff_lines JOIN r USING (sha) WHERE {_said('content')})
SELECT repo, path FROM p WHERE {_hand_rules()} OR EXISTS (SELECT 1 FROM s WHERE s.repo = p.repo AND s.path = p.path)""",
        # a plainer rule: twelve runs of four words that at most one document in a hundred holds
        "p8_found": f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_words('text')} AS w FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT item_id, p, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS p FROM i)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM d)),
few AS (SELECT g FROM dg WHERE g IN (SELECT g FROM ig) GROUP BY g HAVING count(*) * 100 <= (SELECT count(*) FROM documents) OR count(*) < 4)
SELECT doc_id, item_id FROM dg JOIN ig USING (g) JOIN few USING (g) GROUP BY doc_id, item_id HAVING count(DISTINCT p) >= 12""",
        # any usual size gives the same cases: characters here, tokens there
        "p9_found": """
WITH d AS (SELECT replace(lower(trim(source)), '-', '_') AS source, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT source, sum(n) AS n FROM d GROUP BY source)
SELECT t.source FROM mix_targets t LEFT JOIN s USING (source) WHERE coalesce(s.n, 0) * max_repeats < target_share * (SELECT sum(n) FROM d)""",
        "p10_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 3)) AS p, w FROM d WHERE len(w) >= 5),
k AS (SELECT doc_id, n, p, array_to_string(w[p:p + 4], ' ') AS run FROM g),
r AS (SELECT doc_id, n, p, row_number() OVER (PARTITION BY doc_id, run ORDER BY p) AS nth FROM k),
m AS (SELECT doc_id, any_value(n) AS n, count(DISTINCT p + o) AS hit FROM (SELECT doc_id, n, p, unnest(range(0, 5)) AS o FROM r WHERE nth > 1) GROUP BY doc_id)
SELECT doc_id FROM m WHERE hit >= 0.35 * n""",
    }
