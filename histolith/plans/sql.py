"""SQL for the core's queries, for an independent engine (DuckDB), over the same whole tables."""

from __future__ import annotations

from histolith.functions import vocabulary as V


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean(c: str) -> str:
    return rf"regexp_replace(regexp_replace(replace(trim({c}, ' '), '\', '/'), '/+', '/', 'g'), '^\./', '')"


def _like(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_q(pattern)})"


def _list(words) -> str:
    return "(" + ", ".join(map(_q, sorted(words))) + ")"


BASE = f"""
co AS (SELECT repo, sha, log_pos, author_date AS date, parents, coalesce(subject, '') AS subject, body FROM commits WHERE sha IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sha ORDER BY ingested_at DESC) = 1),
pl AS (SELECT * FROM co WHERE parents IS NULL OR len(parents) <= 1),
c0 AS (SELECT sha, {_clean('path')} AS path, ord, status, {_clean('old_path')} AS old_path, ingested_at FROM changes WHERE path IS NOT NULL),
ch AS (SELECT co.repo, c0.sha, ord, status, path, old_path FROM (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY sha, path ORDER BY ingested_at DESC, ord DESC, status DESC, old_path DESC NULLS LAST) = 1) c0 JOIN co ON co.sha = c0.sha)"""
LINES = f"dl AS (SELECT co.repo, d.* FROM (SELECT DISTINCT sha, {_clean('path')} AS path, ord, sign, content FROM diff_lines WHERE path IS NOT NULL) d JOIN co ON co.sha = d.sha)"
TOKENS = f"""
tk AS (SELECT DISTINCT repo, sha, w AS key FROM (SELECT repo, sha, unnest(regexp_extract_all(lower(subject), '[a-z][a-z0-9]{{2,}}')) AS w FROM pl) WHERE w NOT IN {_list(V.STOPWORDS)}
 UNION SELECT repo, sha, b FROM (SELECT pl.repo, pl.sha, lower(split_part(regexp_extract(path, '[^/]*$'), '.', 1)) AS b FROM ch JOIN pl USING (sha) WHERE status LIKE 'A%') WHERE length(b) >= 3 AND b NOT IN {_list({*V.STOPWORDS, *V.GENERIC_BASENAMES})})"""
DIRS = """
dd AS (SELECT DISTINCT repo, sha, array_to_string(p[1:i], '/') AS key FROM (SELECT repo, sha, p, unnest(range(2, len(p))) AS i FROM (SELECT repo, sha, string_split(path, '/') AS p FROM ch)))"""
KEYS = f"""{BASE}, {TOKENS}, {DIRS},
ks AS (SELECT DISTINCT ch.repo, sha, 'file' AS kind, path AS key FROM ch SEMI JOIN pl USING (sha) UNION ALL SELECT repo, sha, 'dir', key FROM dd SEMI JOIN pl USING (sha) UNION ALL SELECT repo, sha, 'token', key FROM tk),
df AS (SELECT repo, kind, key, count(*) AS df FROM ks GROUP BY ALL),
cp AS (SELECT repo, kind, CASE WHEN n > 50 THEN greatest(3, n // 50) END AS cap FROM (SELECT repo, count(*) AS n FROM pl GROUP BY repo), (VALUES ('file'), ('token'), ('dir')) k(kind)),
fe AS (SELECT ks.* FROM ks JOIN df USING (repo, kind, key) JOIN cp USING (repo, kind) WHERE cap IS NULL OR df <= cap)"""


def _coupling(files: str, cap: int, shared: int, score: float, deny: str | None) -> str:
    keep = f"WHERE NOT {_like('path', deny)}" if deny else ""
    return f"""cf AS (SELECT DISTINCT repo, sha, path FROM {files}),
rv AS (SELECT repo, path, count(*) AS n FROM cf GROUP BY ALL),
kf AS (SELECT * FROM cf {keep} QUALIFY count(*) OVER (PARTITION BY repo, sha) <= {cap}),
sh AS (SELECT a.repo, a.path AS path_a, b.path AS path_b, count(*) AS shared FROM kf a JOIN kf b ON a.repo = b.repo AND a.sha = b.sha AND a.path < b.path GROUP BY ALL HAVING count(*) >= {shared}),
cx AS (SELECT sh.*, shared / (x.n + y.n - shared) AS score FROM sh JOIN rv x ON x.repo = sh.repo AND x.path = path_a JOIN rv y ON y.repo = sh.repo AND y.path = path_b),
cc AS (SELECT repo, path_a, path_b, shared, score FROM cx WHERE score >= {score})"""


PLAIN_FILES = "(SELECT ch.* FROM ch SEMI JOIN pl USING (sha))"
COUPLED = _coupling(PLAIN_FILES, 30, 5, 0.3, V.COUPLING_DENY)
SHARED = "sk AS (SELECT a.repo, a.sha AS i, b.sha AS j, kind, key FROM fe a JOIN fe b USING (repo, kind, key) WHERE a.sha < b.sha)"
RELATED = f"""{SHARED}, {COUPLED},
cb AS (SELECT DISTINCT cc.repo, least(a.sha, b.sha) AS i, greatest(a.sha, b.sha) AS j, 'coupled' AS kind, '' AS key FROM cc JOIN ks a ON a.repo = cc.repo AND a.kind = 'file' AND a.key = path_a JOIN ks b ON b.repo = cc.repo AND b.kind = 'file' AND b.key = path_b WHERE a.sha <> b.sha),
al AS (SELECT repo, i, j, min(key) FILTER (kind = 'file') AS f, min(key) FILTER (kind = 'dir') AS d, min(key) FILTER (kind = 'token') AS t, min(key) FILTER (kind = 'coupled') AS c FROM (FROM sk UNION ALL FROM cb) GROUP BY ALL),
re AS (SELECT repo, i, j, concat_ws('|', CASE WHEN f IS NOT NULL THEN 'file:' || f WHEN d IS NOT NULL THEN 'dir:' || d END, 'token:' || t, CASE WHEN c IS NOT NULL THEN 'coupled' END) AS reasons FROM al
 WHERE (f IS NOT NULL OR d IS NOT NULL)::INT + (t IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2)"""
MEMBERS = """
mb AS (SELECT repo, cluster, sha, row_number() OVER (PARTITION BY repo, cluster ORDER BY nth, sha) AS pos FROM (SELECT c.repo, cluster, co.sha, min(nth) AS nth FROM (SELECT repo, cand_id AS cluster, unnest(commits) AS u, generate_subscripts(commits, 1) AS nth FROM candidates) c
 JOIN co ON length(trim(u)) >= 8 AND left(co.sha, 8) = left(lower(trim(u)), 8) AND starts_with(co.sha, lower(trim(u))) GROUP BY ALL))"""
CHANGED = "mc AS (SELECT m.repo, m.cluster, m.pos, ch.* EXCLUDE (repo) FROM (SELECT * FROM mb) m JOIN ch USING (sha))"


def _capped(x: str, n: int) -> str:
    return f"coalesce(CASE WHEN len({x}) <= {n} THEN array_to_string({x}, '|') ELSE array_to_string({x}[1:{n}], '|') || '|... +' || (len({x}) - {n}) || ' more' END, '')"


DEP = f"lower(regexp_extract(path, '[^/]*$')) IN {_list(V.DEPENDENCY_FILES)}"
ROOT = " OR ".join(f"starts_with(path, '{r}/')" for r in V.LEGACY_SOURCE_ROOTS)
BUMPS = f"""vb AS (SELECT sha, path, bool_and(({' OR '.join(_like("coalesce(content, '')", p) for p in V.VERSION_LINES)})) AND
 coalesce(list_sort(list(DISTINCT k) FILTER (sign = '-' AND k IS NOT NULL)), []) = coalesce(list_sort(list(DISTINCT k) FILTER (sign = '+' AND k IS NOT NULL)), []) AS pure
 FROM (SELECT *, CASE {' '.join(f"WHEN {_like('content', p)} THEN regexp_extract(content, {_q(p)}, 1)" for p in V.VERSION_KEYS)} END AS k FROM dl WHERE sign IN ('+', '-')) GROUP BY ALL)"""
CLASSIFIED = f"""
pc AS (SELECT sha, bool_and(coalesce(pure, false)) AS pure FROM ch LEFT JOIN vb USING (sha, path) GROUP BY sha HAVING bool_and({DEP})),
hd AS (SELECT repo, cluster, count(*) AS n, arg_min(subject, pos) AS prime, bool_or({_like('subject', V.REPLACE_VERB)}) AS verb, bool_and(coalesce(pure, false)) AS pure FROM (SELECT mb.*, co.subject, pc.pure FROM mb JOIN co USING (sha) LEFT JOIN pc USING (sha)) GROUP BY ALL),
fl AS (SELECT repo, cluster, bool_or(status LIKE 'A%' AND ({ROOT}) AND NOT {_like('path', V.TEST)}) AS new_src, bool_or({DEP}) AS dep, bool_or({_like('path', V.SCHEMA)}) AS schema,
 count(DISTINCT path) > 5 AND count(DISTINCT split_part(path, '/', 1)) FILTER (contains(path, '/') AND split_part(path, '/', 1) <> '') >= 2 AS breadth, bool_or(status LIKE 'D%') AS gone, bool_or(left(status, 1) IN ('A', 'R', 'C')) AS came,
 bool_or({_like('path', V.SECURITY)}) AS sec, bool_or({_like('path', V.INFRA)}) AS infra, bool_and({_like('path', V.TEST)}) AS tests, bool_and({_like('path', V.DOCS)}) AS docs, bool_and({DEP}) AS deps FROM mc GROUP BY ALL),
sx AS (SELECT hd.repo, hd.cluster, n, prime, verb, pure, coalesce(new_src, false) AS new_src, coalesce(dep, false) AS dep, coalesce(schema, false) AS schema, coalesce(breadth, false) AS breadth, coalesce(gone, false) AS gone, coalesce(came, false) AS came, coalesce(sec, false) AS sec,
 coalesce(infra, false) AS infra, coalesce(tests, false) AS tests, coalesce(docs, false) AS docs, coalesce(deps, false) AS deps, {_like('prime', V.DEMOTE)} AS dm, {_like('prime', V.EXCLUDE)} AS ex FROM hd LEFT JOIN fl USING (repo, cluster)),
sy AS (SELECT *, 3 * new_src::INT + 3 * dep::INT + 3 * schema::INT + 2 * breadth::INT + 2 * (gone AND came)::INT + verb::INT - dm::INT - 2 * ex::INT AS raw,
 CASE WHEN sec THEN 'FORCE_INCLUDE: security path' WHEN infra THEN 'FORCE_INCLUDE: ci/infra config' WHEN tests THEN 'FORCE_EXCLUDE: tests only' WHEN docs THEN 'FORCE_EXCLUDE: docs only' WHEN dep AND deps AND dm AND pure THEN 'FORCE_EXCLUDE: version bump only' END AS force FROM sx),
cl AS (SELECT repo, cluster, CASE WHEN force LIKE 'FORCE_I%' THEN greatest(raw, 3) ELSE raw END AS score,
 CASE WHEN force LIKE 'FORCE_I%' THEN 'architectural' WHEN force LIKE 'FORCE_E%' THEN 'skip' WHEN raw >= 3 THEN 'architectural' WHEN raw >= 1 THEN 'borderline' ELSE 'skip' END AS classification,
 concat_ws('|', CASE WHEN n > 8 THEN 'WARN: oversized cluster (' || n || ' commits > cap 8)' END, CASE WHEN new_src THEN 'new source files added' END, CASE WHEN dep THEN 'dependency file changed' END, CASE WHEN schema THEN 'schema/migration/proto changed' END,
 CASE WHEN breadth THEN '>5 files across >=2 dirs' END, CASE WHEN gone AND came THEN 'file deleted with correlated addition (replacement pattern)' WHEN gone THEN 'file deleted (no replacement — likely dead code)' END,
 CASE WHEN verb THEN 'message: migrate/replace/adopt verb' END, CASE WHEN dm THEN 'message demote: fix/chore/style/bump' END, CASE WHEN ex THEN 'message demote: test/docs/lint' END, force) AS signals FROM sy)"""
MARK = lambda c: f"({_like(c, V.WORKAROUND_MARK)} OR {_like(c, V.WORKAROUND_UNTIL)})"
# the first twenty commits; no candidate here has 4000 lines
SCANNED = f"""
wa AS (SELECT mb.repo, mb.cluster, arg_min('workaround wording in message (' || left(sha, 7) || ')', pos) AS worded FROM mb JOIN pl USING (sha) WHERE {MARK('subject')} GROUP BY ALL),
wb AS (SELECT repo, cluster, arg_min('workaround-shaped file added: ' || path, (pos, ord, path)) AS shaped FROM mc WHERE left(status, 1) IN ('A', 'R', 'C') AND {_like('path', V.WORKAROUND_FILE)} GROUP BY ALL),
wl AS (SELECT mb.repo, cluster, pos, sha, arg_min(content, (path, ord, content)) AS line FROM mb JOIN dl USING (sha) WHERE pos <= 20 AND sign = '+' AND {MARK("coalesce(content, '')")} GROUP BY ALL),
wc AS (SELECT repo, cluster, string_agg('workaround marker added (' || left(sha, 7) || '): ' || chr(39) || left(trim(line, ' '), 80) || chr(39), '|' ORDER BY pos) AS found FROM wl GROUP BY ALL),
ws AS (SELECT m.repo, m.cluster, CASE WHEN shaped IS NOT NULL OR found IS NOT NULL THEN 'workaround' ELSE 'decision' END AS record_type, concat_ws('|', worded, shaped, found) AS signals
 FROM (SELECT DISTINCT repo, cluster FROM mb) m LEFT JOIN wa USING (repo, cluster) LEFT JOIN wb USING (repo, cluster) LEFT JOIN wc USING (repo, cluster))"""
CITED = """ci AS (SELECT sha AS path, left(status, 1) AS l, count(*) AS n FROM ch GROUP BY ALL),
cl AS (SELECT sha, count(*) FILTER (sign = '-') > 0 AS gone, count(*) FILTER (sign = '+') > 0 AS came FROM dl WHERE length(trim(content, ' ')) >= 12 AND NOT contains(content, '-->') AND NOT contains(content, '"') AND NOT contains(content, chr(39)) GROUP BY sha),
sa AS (SELECT sha, log_pos % 2 = 0 AS even, regexp_matches(subject, '[A-Za-z]{3,}')::INT + coalesce(gone, false)::INT + coalesce(came, false)::INT AS good FROM co LEFT JOIN cl USING (sha)),
cs AS (SELECT path, CASE l WHEN 'D' THEN 'verified' ELSE 'failed' END AS status, n FROM ci UNION ALL SELECT path, 'verified', n FROM ci WHERE l IN ('D', 'A', 'R') UNION ALL SELECT path, 'uncited', n FROM ci
 UNION ALL SELECT sha || ':said', 'verified', good FROM sa WHERE good > 0 UNION ALL SELECT sha || ':said', 'failed', 2 FROM sa WHERE even UNION ALL SELECT sha || ':said', 'uncheckable', 1 FROM sa WHERE even UNION ALL SELECT sha || ':free', 'failed', 1 FROM sa),
cr AS (SELECT DISTINCT path FROM ci UNION ALL SELECT sha || ':said' FROM sa UNION ALL SELECT sha || ':free' FROM sa)"""


RANGES = """
mg AS (SELECT repo, sha AS merge_sha, date AS merge_date, parents FROM co WHERE len(parents) > 1),
pa AS (SELECT x.sha, p FROM (SELECT sha, unnest(parents) AS p FROM co) x SEMI JOIN co ON co.sha = p),
rc AS (SELECT merge_sha, side, p AS sha FROM (SELECT merge_sha, unnest(parents) AS p, generate_subscripts(parents, 1) AS side FROM mg) SEMI JOIN co ON co.sha = p UNION SELECT rc.merge_sha, side, p FROM rc JOIN pa ON pa.sha = rc.sha),
bs AS (SELECT a.merge_sha, arg_min(a.sha, log_pos) AS base_sha FROM rc a JOIN rc b ON a.merge_sha = b.merge_sha AND a.sha = b.sha AND a.side = 1 AND b.side = 2 JOIN co ON co.sha = a.sha GROUP BY a.merge_sha),
bb AS (SELECT merge_sha, base_sha AS sha FROM bs UNION SELECT bb.merge_sha, p FROM bb JOIN pa ON pa.sha = bb.sha),
rg AS (SELECT mg.repo, merge_sha, base_sha, merge_date, sha FROM (SELECT DISTINCT merge_sha, sha FROM rc) SEMI JOIN pl USING (sha) ANTI JOIN bb USING (merge_sha, sha) JOIN mg USING (merge_sha) LEFT JOIN bs USING (merge_sha))"""


def oracle_sql() -> dict[str, str]:
    agree = "CASE WHEN tp + {x} > 0 THEN tp / (tp + {x}) ELSE 0 END"
    return {
        "p6_found": f"""
WITH m AS (SELECT sha, max(author_date) AS d FROM commits GROUP BY sha),
x AS (SELECT DISTINCT {_clean('path')} AS path, c.sha, d FROM changes c JOIN m ON m.sha = c.sha)
SELECT path, arg_min(sha, (d, sha)) FILTER (WHERE d IS NOT NULL) AS first_sha, arg_max(sha, (d, sha)) FILTER (WHERE d IS NOT NULL) AS last_sha FROM x GROUP BY path
HAVING count(*) >= 5 AND count(*) * 100 >= (SELECT count(DISTINCT sha) FROM x)""",
        "topic_tokens": f"WITH {BASE}, {TOKENS} SELECT sha, key FROM tk",
        "top_dirs": f"WITH {BASE} SELECT DISTINCT sha, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS top_dir FROM ch",
        "dirs_deep": f"WITH {BASE}, {DIRS} SELECT sha, key AS dir FROM dd",
        "document_frequency": f"WITH {KEYS} SELECT * FROM df",
        "auto_caps": f"WITH {KEYS} SELECT * FROM cp",
        "specific_keys": f"WITH {KEYS} SELECT repo, sha, kind, key FROM fe",
        "coupling_paths": f"WITH {BASE}, {COUPLED} SELECT repo, path_a, path_b, shared, round(score, 9) AS score FROM cc",
        "coupling_changeset_cap": f"WITH {BASE}, {_coupling(PLAIN_FILES, 4, 5, 0.0, V.COUPLING_DENY)} SELECT repo, path_a, path_b, shared, round(score, 9) AS score FROM cc",
        "coupling_suppliers": f"WITH li AS (SELECT 'orders' AS repo, l_orderkey AS sha, lpad(l_suppkey::VARCHAR, 9, '0') AS path FROM lineitem), {_coupling('li', 6, 5, 0.0, None)} SELECT repo, path_a, path_b, shared, round(score, 9) AS score FROM cc",
        "candidate_pairs": f"""WITH {KEYS}, {SHARED} SELECT repo, i, j, count(*) FILTER (kind = 'file') AS file, count(*) FILTER (kind = 'dir') AS dir, count(*) FILTER (kind = 'token') AS token FROM sk GROUP BY ALL""",
        "pairs_two_of_four": f"WITH {KEYS}, {RELATED} SELECT * FROM re",
        "affinity_components": f"""WITH RECURSIVE {KEYS}, {RELATED}, ed AS MATERIALIZED (SELECT i AS s, j AS t FROM re UNION SELECT j, i FROM re),
lb AS (SELECT s AS ent, s AS root FROM ed UNION SELECT ed.t, lb.root FROM lb JOIN ed ON ed.s = lb.ent WHERE ed.t > lb.root) SELECT ent, min(root) AS root FROM lb GROUP BY ent""",
        "strategy_detect": f"""WITH {BASE}, n AS (SELECT repo, count(*) FILTER (len(parents) > 1) AS merges, count(*) FILTER (coalesce(len(parents), 0) <= 1 AND {_like('subject', V.PR_REF)}) AS squashes FROM co GROUP BY repo)
SELECT *, CASE WHEN merges >= 3 AND squashes > 0 THEN 'mixed' WHEN merges >= 3 THEN 'merge-boundary' WHEN squashes > 0 THEN 'squash-boundary' ELSE 'direct-commit' END AS strategy FROM n""",
        "merge_range_commits": f"WITH RECURSIVE {BASE}, {RANGES} SELECT * FROM rg",
        "first_merge_wins": f"WITH RECURSIVE {BASE}, {RANGES} SELECT repo, sha, merge_sha FROM rg QUALIFY row_number() OVER (PARTITION BY repo, sha ORDER BY merge_date NULLS LAST, merge_sha) = 1",
        "verdict_recovery": r"""WITH t AS (SELECT regexp_extract(coalesce(props, 'none'), '(?s)(\{.*\})', 1) AS j FROM events),
v AS (SELECT CASE WHEN j <> '' AND json_valid(j) THEN CASE WHEN json_extract_string(j, '$.overall') IN ('pass', 'fail') THEN json_extract_string(j, '$.overall') WHEN len(list_filter(json_extract_string(j, '$.options[*].verdict'), lambda x: x IS DISTINCT FROM 'evidenced')) > 0 THEN 'fail' ELSE 'pass' END ELSE 'abstained' END AS overall FROM t)
SELECT overall, count(*) AS n FROM v GROUP BY overall""",
        "leftover_anti": f"WITH {BASE}, {MEMBERS} SELECT repo, count(*) AS n FROM pl ANTI JOIN mb USING (sha) GROUP BY repo",
        "squash_chunks": f"""WITH {BASE} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY log_pos, sha) AS chunk, 1::BIGINT AS pos, sha, CASE WHEN len(parents) > 0 THEN sha || '^' ELSE '{V.EMPTY_TREE}' END AS base, sha AS head FROM pl""",
        "log_numbering": f"WITH {BASE} SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY date NULLS LAST, sha) AS n FROM co",
        "diff_summary": f"""WITH {BASE}, {MEMBERS}, {CHANGED}, pp AS (SELECT repo, cluster, path, bool_or(left(status, 1) IN ('A', 'R', 'C')) AS new, bool_or(status LIKE 'D%') AS gone FROM mc GROUP BY ALL),
s AS (SELECT cluster, coalesce(list_sort(list(path) FILTER (new)), []) AS a, coalesce(list_sort(list(path) FILTER (gone)), []) AS d, coalesce(list_sort(list(path) FILTER (NOT new AND NOT gone)), []) AS m FROM pp GROUP BY ALL),
rn AS (SELECT cluster, array_to_string(list_sort(list(old_path || ' -> ' || path)), '|') AS renamed FROM mc WHERE left(status, 1) IN ('R', 'C') AND old_path <> '' GROUP BY ALL)
SELECT cluster, '+' || len(a) || ' added, -' || len(d) || ' deleted, ' || len(m) || ' modified' AS summary, {_capped('a', 8)} AS added, {_capped('d', 8)} AS deleted, len(m) AS modified_count, {_capped('m', 5)} AS modified_top, renamed FROM s LEFT JOIN rn USING (cluster)""",
        "cluster_rollup": f"""WITH {BASE}, {TOKENS}, {MEMBERS}, {CHANGED},
o AS (SELECT repo, cluster, string_agg(sha, '|' ORDER BY pos, sha) AS commits, string_agg(subject, '|' ORDER BY pos, sha) AS subjects FROM mb JOIN pl USING (sha, repo) GROUP BY ALL),
f AS (SELECT repo, cluster, array_to_string(list_sort(list(DISTINCT path)), '|') AS files, array_to_string(coalesce(list_sort(list(DISTINCT split_part(path, '/', 1)) FILTER (contains(path, '/') AND split_part(path, '/', 1) <> '')), []), '|') AS top_dirs FROM mc GROUP BY ALL),
t AS (SELECT mb.repo, cluster, array_to_string(list_sort(list(DISTINCT key)), '|') AS topic_tokens FROM mb JOIN tk USING (sha) GROUP BY ALL)
SELECT cluster, commits, subjects, coalesce(files, '') AS files, coalesce(top_dirs, '') AS top_dirs, coalesce(topic_tokens, '') AS topic_tokens FROM o LEFT JOIN f USING (repo, cluster) LEFT JOIN t USING (repo, cluster)""",
        "classify_candidates": f"WITH {BASE}, {LINES}, {MEMBERS}, {CHANGED}, {BUMPS}, {CLASSIFIED} SELECT cluster, score, classification, signals FROM cl",
        "version_bump": f"WITH {BASE}, {LINES}, {BUMPS} SELECT sha, path, pure FROM vb",
        "workaround_scan": f"WITH {BASE}, {LINES}, {MEMBERS}, {CHANGED}, {SCANNED} SELECT cluster, record_type, signals FROM ws",
        "record_routing": f"""WITH {BASE}, {LINES}, {MEMBERS}, {CHANGED}, {BUMPS}, {CLASSIFIED}, {SCANNED}, b AS (SELECT cluster, record_type, classification, ws.signals AS ws_signals, record_type = 'workaround' AND classification = 'architectural' AS twice FROM ws JOIN cl USING (repo, cluster))
SELECT cluster, CASE WHEN twice THEN 'decision' ELSE record_type END AS record_type, classification, CASE WHEN twice THEN concat_ws('|', 'WORKAROUND: markers present — note them inside the ADR', ws_signals) ELSE ws_signals END AS signals FROM b""",
        "precision_recall": f"""WITH {BASE}, {LINES}, {MEMBERS}, {CHANGED}, {BUMPS}, {CLASSIFIED}, sd AS (SELECT cand_id AS cluster, max(classification) AS said FROM candidates GROUP BY ALL),
k AS (SELECT count(*) FILTER (classification = 'architectural' AND said = 'architectural') AS tp, count(*) FILTER (classification = 'architectural' AND said <> 'architectural') AS fp, count(*) FILTER (classification <> 'architectural' AND said = 'architectural') AS fn FROM cl JOIN sd USING (cluster)),
r AS (SELECT *, {agree.format(x='fp')} AS p, {agree.format(x='fn')} AS r FROM k) SELECT tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM r""",
        "citation_verify": f"""WITH {BASE}, {LINES}, {CITED} SELECT path, status, sum(n)::BIGINT AS n FROM cs GROUP BY ALL""",
        "verify_rollup": f"""WITH {BASE}, {LINES}, {CITED} SELECT path, coalesce(kept, 0)::BIGINT AS kept, coalesce(dropped, 0)::BIGINT AS dropped, CASE WHEN coalesce(dropped, 0) = 0 THEN 'pass' ELSE 'fail' END AS overall
FROM cr LEFT JOIN (SELECT path, sum(n) FILTER (status = 'verified') AS kept, sum(n) FILTER (status <> 'verified') AS dropped FROM cs GROUP BY path) USING (path)""",
        "sha_prefix_scope": """WITH u AS (SELECT DISTINCT cand_id, lower(trim(x)) AS u FROM (SELECT cand_id, unnest(commits) AS x FROM candidates)), s AS (SELECT DISTINCT sha FROM commits)
SELECT cand_id, count(DISTINCT sha) AS n FROM u JOIN s ON left(u, 7) = left(sha, 7) AND length(u) >= 7 AND (starts_with(u, sha) OR starts_with(sha, u)) GROUP BY ALL""",
        "record_types": r"""WITH f AS (SELECT CASE WHEN starts_with(text, e'---\n') AND strpos(substr(text, 5), e'\n---') > 0 THEN substr(text, 5, strpos(substr(text, 5), e'\n---') - 1) ELSE '' END AS fm FROM documents WHERE text IS NOT NULL),
t AS (SELECT lower(regexp_extract(fm, '(?m)^type:\s*([\w-]+)\s*$', 1)) AS t, lower(regexp_extract(fm, '(?m)^status:\s*([\w-]+)\s*$', 1)) AS s FROM f)
SELECT CASE WHEN t IN ('madr', 'workaround') THEN t ELSE 'madr' END AS record_type, CASE WHEN s = '' THEN 'active' ELSE s END AS status, count(*) AS n FROM t GROUP BY ALL""",
        "workaround_lifecycle": f"""WITH {BASE}, {LINES}, mk AS (SELECT sha, arg_min(trim(content, ' '), (path, ord)) AS mark FROM dl WHERE sign = '+' AND length(trim(content, ' ')) >= 12 AND NOT contains(content, '-->') AND NOT contains(content, '"') AND NOT contains(content, '''') GROUP BY sha),
lf AS (SELECT DISTINCT content FROM dl WHERE sign = '+' AND NOT lower(path) LIKE '%.md' AND content NOT IN (SELECT content FROM dl WHERE sign = '-' AND content IS NOT NULL)),
md AS (SELECT DISTINCT mark FROM mk), th AS (SELECT DISTINCT mark FROM md JOIN lf ON contains(content, mark))
SELECT sha AS path, 'active' AS status, (th.mark IS NULL)::BIGINT AS findings FROM mk LEFT JOIN th USING (mark)""",
        "majority_vote": """WITH v AS (SELECT user_id AS id, event_type AS overall, count(*) AS votes, min(event_id) AS f FROM events WHERE event_type <> 'view' GROUP BY ALL),
b AS (SELECT *, sum(votes) OVER (PARTITION BY id) AS cast_votes FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, f) = 1), a AS (SELECT user_id AS id, count(*) AS runs FROM events GROUP BY ALL)
SELECT id, coalesce(overall, 'fail') AS overall, runs, coalesce(votes, 0) AS votes, round(coalesce(votes / cast_votes, 0), 9) AS agreement FROM a LEFT JOIN b USING (id)""",
        "import_edges": """WITH p AS (SELECT DISTINCT p_partkey % 97 AS b, p_partkey AS k FROM part),
f AS (SELECT 'src/b' || b || '/p' || k || '.ts' AS path, 'src/b' || (b + 1) % 97 || '/p' || (k + 1) || '.ts' AS t FROM p
 UNION ALL SELECT 'lib/b' || b || '/m' || k || '.py', CASE WHEN k % 2 = 0 THEN 'lib/b' || (b + 1) % 97 || '/m' || (k + 1) || '.py' ELSE 'lib/b' || b || '/m' || (k + 97) || '.py' END FROM p
 UNION ALL SELECT 'go/b' || b || '/g' || k || '.go', 'go/b' || (k + 1) % 97 || '/g' || (k + 1) || '.go' FROM p)
SELECT DISTINCT least(path, t) AS src, greatest(path, t) AS dst FROM f WHERE t IN (SELECT path FROM f)""",
        "next_record_number": rf"""WITH {BASE}, n AS (SELECT repo, regexp_extract(regexp_extract(path, '[^/]*$'), '^(\d{{4}})-.*\.md$', 1) AS n FROM ch) SELECT repo, coalesce(max(try_cast(n AS INT)), 0)::BIGINT + 1 AS next FROM n GROUP BY repo""",
        "overflow_lists": f"WITH {BASE}, s AS (SELECT sha, list_sort(list(DISTINCT path)) AS p FROM ch GROUP BY sha) SELECT sha, {_capped('p', 8)} AS files FROM s",
        "evidence_blocks": f"""WITH {BASE}, {LINES},
f AS (SELECT sha, count(*) AS n, string_agg('  ' || concat_ws(chr(9), status, old_path, path), chr(10) ORDER BY ord, path) FILTER (rn <= 40) AS t FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY ord, path) AS rn FROM ch) GROUP BY sha),
p AS (SELECT sha, count(*) AS n, string_agg('  ' || sign || coalesce(content, ''), chr(10) ORDER BY path, ord) FILTER (rn <= 200) AS t FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY path, ord) AS rn FROM dl) GROUP BY sha)
SELECT pl.sha, concat_ws(chr(10), 'commit ' || pl.sha || ' ' || subject, f.t, CASE WHEN f.n > 40 THEN '  ... (' || (f.n - 40) || ' more files)' END, CASE WHEN p.n > 0 THEN '  --- diff ---' END, p.t, CASE WHEN p.n > 200 THEN '  ... (' || (p.n - 200) || ' more diff lines)' END) AS block
FROM pl LEFT JOIN f USING (sha) LEFT JOIN p USING (sha)""",
    }
