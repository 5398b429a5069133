import pytest
from pyspark.sql import functions as F

from histolith.operators import citations as C, votes
from histolith.operators.imports import import_edges
from histolith.operators.render import render
from histolith.operators.tags import check_syntax, tag_report

SHA = "abcdef1234567890abcdef1234567890abcdef12"
ADR = f"""# X

## Considered Options

* **Redis** <!-- evidence: {SHA[:9]} deleted:src/redis.py -->
* Wrong <!-- evidence: {SHA[:9]} deleted:src/other.py -->
* Odd <!-- evidence: {SHA[:9]} feeling:"x" -->
* Plain
* Said <!-- evidence: {SHA[:7].upper()} message:INSTEAD of redis -->
* Line <!-- evidence: {SHA[:9]} removed:"import redis" -->
* Nowhere <!-- evidence: 1234567 deleted:src/redis.py -->

## Links
"""


@pytest.fixture
def history(rows):
    return (
        rows([(SHA, "swap cache", "use x instead of Redis")], "sha string, subject string, body string"),
        rows([(SHA, 0, "D", "src/redis.py", None), (SHA, 1, "R100", "b", "a")], "sha string, ord int, status string, path string, old_path string"),
        rows([(SHA, "src/x.py", 0, "-", "import redis"), (SHA, "src/x.py", 1, "+", "-- HACK: x")], "sha string, path string, ord int, sign string, content string"),
    )


def statuses(rows, history, text, allowed=None):
    r = rows([("p", text), ("none", None), ("empty", "")], "path string, text string")
    a = rows([("p", allowed)], "path string, shas array<string>") if allowed is not None else None
    return [(v.option, v.status) for v in C.verify(C.citations(r), *history, a).orderBy("ord").collect()]


def test_verdict_ladder(rows, history):
    assert statuses(rows, history, ADR) == [("Redis", "verified"), ("Wrong", "failed"), ("Odd", "uncheckable"), ("Plain", "uncited"), ("Said", "verified"), ("Line", "verified"), ("Nowhere", "failed")]


@pytest.mark.parametrize("allowed, first", [([SHA], "verified"), ([SHA[:7]], "verified"), ([SHA[:1]], "failed"), ([], "failed"), (["f" * 40], "failed")])
def test_scope(rows, history, allowed, first):
    assert statuses(rows, history, ADR, allowed)[0][1] == first


def test_links_scope_and_sections(rows, history):
    text = f"---\ntype: workaround\nstatus: removed\n---\n## Evidence\n- m <!-- evidence: {SHA[:8]} marker:\"-- HACK\" -->\n## Links\n- Commits: ffffffff, eeeeeee\n"
    assert statuses(rows, history, text) == [("m", "failed")]
    assert statuses(rows, history, text.replace("ffffffff", SHA[:10])) == [("m", "verified")]


def test_rollup(rows, history):
    r = rows([("p", ADR), ("q", "no section"), ("n", "## Considered Options\n\nNo alternatives recorded in it.\n- a\n")], "path string, text string")
    cited = C.citations(r)
    got = {v.path: (v.kept, v.dropped, v.overall) for v in C.verdicts(r, C.verify(cited, *history)).collect()}
    assert got == {"p": (3, 4, "fail"), "q": (0, 0, "pass"), "n": (0, 0, "pass")}


def test_lifecycle(rows):
    rec = lambda status, mark: f"---\ntype: workaround\nstatus: {status}\n---\n## Evidence\n" + (f'- x <!-- evidence: {SHA[:8]} marker:"{mark}" -->\n' if mark else "") + "see https://github.com/a/b/issues/7\n"
    r = rows([("kept", rec("active", "HACK: one")), ("gone", rec("active", "HACK: two")), ("old", rec("removed", "HACK: two")), ("bare", rec("active", None)), ("adr", "# no")], "path string, text string")
    tree = rows([("a.py", "x  # HACK: one"), ("b.md", "HACK: two"), ("c.py", None)], "path string, line string")
    got = {x.path: len(x.findings) for x in C.lifecycle(r, tree).collect()}
    assert got == {"kept": 0, "gone": 1, "old": 0, "bare": 1}
    closed = rows([("https://github.com/a/b/issues/7",)], "url string")
    assert {x.path: len(x.findings) for x in C.lifecycle(r, tree, closed).collect()}["kept"] == 1


def test_lifecycle_query_reads_the_whole_tree(spark, tmp_path):
    from histolith.plans.queries import workaround_lifecycle

    c = "sha string, repo string, log_pos long, parents array<string>, author string, author_date date, subject string, body string, ingested_at timestamp"
    long = "x = y  # HACK: " + "word " * 12 + "end"
    lines = [("a" * 40, "lib/a.py", "+", "retry()  # HACK: outside src"), ("b" * 40, "src/b.py", "+", long), ("c" * 40, "core/c.py", "+", "gone()  # HACK: taken back"), ("d" * 40, "core/c.py", "-", "gone()  # HACK: taken back")]
    spark.createDataFrame([(s, "r", k, [], "x", None, "s", "", None) for k, s in enumerate(x * 40 for x in "abcd")], c).write.parquet(f"{tmp_path}/commits.parquet")
    spark.createDataFrame([(s, "M", None, p, k, None) for k, (s, p, _, _) in enumerate(lines)], "sha string, status string, old_path string, path string, ord int, ingested_at timestamp").write.parquet(f"{tmp_path}/changes.parquet")
    spark.createDataFrame([(s, p, k, g, t) for k, (s, p, g, t) in enumerate(lines)], "sha string, path string, ord int, sign string, content string").write.parquet(f"{tmp_path}/diff_lines.parquet")
    assert {r.path[0]: r.findings for r in workaround_lifecycle(spark, str(tmp_path)).collect()} == {"a": 0, "b": 0, "c": 1}


def test_texts_in_lines(rows):
    texts = ["ab", "zz", "a longer text", "a longer texts", "longer text, é", "longer text, e"]
    got = C.contained(rows([(t,) for t in [*texts, None]], "detail string"), rows([("so: a longer text, é",), ("ab",), (None,)], "line string"))
    assert {r.detail for r in got.collect()} == {"ab", "a longer text", "longer text, é"}


def test_rendering_is_idempotent(rows):
    def rendered(text, kept, dropped, scoped=False, kind="madr"):
        v = rows([("p", n, k, "verified") for n, k in enumerate(kept)] + [("p", 90 + n, "x", "failed") for n in range(dropped)], "path string, ord int, raw string, status string")
        return render(rows([("p", text)], "path string, text string"), v, rows([("p", kind, scoped)], "path string, record_type string, scoped boolean"), "m", "2024-01-01").first().text

    once = rendered(ADR, ["Redis <!-- x -->"], 2)
    assert once == rendered(once, ["Redis <!-- x -->"], 2)
    assert once.startswith("---\ngeneration:\n  method: m\n") and once.endswith("- Redis <!-- x -->\n\n## Links\n")
    assert "Plain" not in once and "options-dropped: 2" in once and "\n\n\n" not in once and "unscoped" in once
    assert "No alternatives recorded" in rendered(ADR, [], 7, True) and "unscoped" not in rendered(ADR, [], 7, True)
    assert rendered("# bare", [], 0).endswith("---\n\n# bare")
    own = "---\ntype: workaround\ngeneration:\n  method: old\n\n  more: x\nstatus: active\n---\n\n## Evidence\n- a\n- b\n"
    got = rendered(own, ["b"], 1, kind="workaround")
    assert got.startswith("---\ntype: workaround\nstatus: active\ngeneration:\n  method: m\n") and got.count("generation:") == 1 and "more" not in got
    assert got.endswith("---\n\n## Evidence\n\n- b\n\n")


def test_votes(rows):
    runs = [(1, 0, "pass"), (1, 1, "pass"), (1, 2, "fail"), (2, 0, "fail"), (2, 1, "pass"), (3, 0, None), (4, 0, None), (4, 1, "pass")]
    got = {r.id: (r.overall, r.runs, round(r.agreement, 3)) for r in votes.majority(rows(runs, "id int, run int, overall string")).collect()}
    assert got == {1: ("pass", 3, 0.667), 2: ("fail", 2, 0.5), 3: ("fail", 1, 0.0), 4: ("pass", 2, 1.0)}


def test_verdict_from_prose(rows):
    raw = ['```json\n{"overall": "pass", "options": []}\n```', 'x {"options": [{"option": "a", "verdict": "no"}]} y', "nothing", "{broken", None]
    df = rows([(i, r) for i, r in enumerate(raw)], "i int, raw string").select("i", votes.parsed(F.col("raw"))["overall"].alias("o"))
    assert [r.o for r in df.orderBy("i").collect()] == ["pass", "fail", None, None, None]


def test_judge_is_injected(spark):
    said = iter(['{"overall": "pass"}', "?", '{"overall": "fail"}'])
    assert votes.judge(spark, ["a"], "e", lambda p: next(said)) == {"overall": "pass", "runs": 3, "agreement": 0.5, "options": []}
    assert votes.judge(spark, [], "e", None)["overall"] == "pass"


def test_import_edges(rows):
    files = {
        "pkg/a.py": "import pkg.b\nfrom c import x\n", "pkg/b.py": "", "pkg/c.py": "", "pkg/d/__init__.py": "import os\n",
        "web/x.ts": "import { a } from './y'\nconst z = require('../web/z')\nimport r from 'react'\n", "web/y.tsx": "", "web/z/index.js": "",
        "go/main.go": 'import "example.com/z/util"\n', "go/util.go": "", "a/util.go": "",
    }
    got = {(r.src, r.dst) for r in import_edges(rows(list(files.items()), "path string, text string")).collect()}
    assert got == {("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/c.py"), ("web/x.ts", "web/y.tsx"), ("web/x.ts", "web/z/index.js"), ("a/util.go", "go/main.go")}


def test_syntax_checks(rows, tmp_path):
    (tmp_path / "good.py").write_text("x = 1\n")
    (tmp_path / "bad.py").write_text("x = = 1\n")
    df = check_syntax(rows([("good.py",), ("bad.py",), ("x.unknown",)], "path string"), str(tmp_path)).cache()
    assert {r.path: r.status for r in df.collect()} == {"good.py": "ok", "bad.py": "fail", "x.unknown": "skipped"}
    assert tuple(tag_report(df).first()) == (3, 1, False)
