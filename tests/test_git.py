import json
import os
import shutil
import subprocess

import pytest

from histolith.model import Config
from histolith.operators import citations
from histolith.operators.merges import merge_ranges
from histolith.plans.pipeline import analyze_repository, report
from histolith.sources import gitlog

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="no git")


class Repo:
    def __init__(self, path):
        self.path, self.day = str(path), 0
        self("init", "-q", "-b", "main")

    def __call__(self, *args):
        date = f"2024-01-{self.day % 28 + 1:02d}T12:00:00"
        env = os.environ | {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
        return subprocess.run(["git", "-c", "user.name=A | B", "-c", "user.email=a@b", "-c", "safe.directory=*", "-C", self.path, *args], check=True, capture_output=True, text=True, env=env).stdout.strip()

    def commit(self, message, **files):
        self.day += 1
        for name, text in files.items():
            full = os.path.join(self.path, name.replace("__", "/"))
            os.makedirs(os.path.dirname(full), exist_ok=True)
            if text is None:
                os.remove(full)
            else:
                with open(full, "w") as f:
                    f.write(text)
        self("add", "-A")
        self("commit", "-q", "-m", message)
        return self("rev-parse", "HEAD")


@pytest.fixture
def repo(tmp_path):
    return Repo(tmp_path)


def test_tables_of_a_repository(spark, repo):
    a = repo.commit("first\n\nbody here", **{"src__a.sql": "-- one\nx\n", "café.txt": "1\n"})
    repo("mv", "src/a.sql", "src/b.sql")
    b = repo.commit("move", **{})
    c = repo.commit("edit", **{"src__b.sql": "-- two\nx\n"})
    own = {"r": repo.path}
    commits = {r.sha: r for r in gitlog.read(spark, "commits", own).collect()}
    assert [commits[s].log_pos for s in (c, b, a)] == [0, 1, 2] and commits[a].author == "A | B" and commits[a].body == "body here" and commits[b].parents == [a]
    changes = {(r.sha, r.path): (r.status, r.old_path) for r in gitlog.read(spark, "changes", own).collect()}
    assert changes[b, "src/b.sql"] == ("R100", "src/a.sql") and changes[a, "café.txt"] == ("A", None)
    lines = [(r.sign, r.content) for r in gitlog.read(spark, "diff_lines", own).where(f"sha = '{c}'").orderBy("ord").collect()]
    assert lines == [("-", "-- one"), ("+", "-- two")]
    span = [(r.path, r.sign, r.content) for r in gitlog.read(spark, "range_diff", own, range=f"{a}..{c}").where("path = 'src/b.sql' AND sign = '+'").collect()]
    assert ("src/b.sql", "+", "-- two") in span
    assert gitlog.read(spark, "files", own).count() == 0
    assert {r.line for r in gitlog.read(spark, "worktree", own).where("path = 'src/b.sql'").collect()} == {"-- two", "x"}


def test_a_log_in_several_partitions(spark, repo, monkeypatch):
    for n in range(7):
        repo.commit(f"c{n}", **{f"f{n}.txt": f"{n}\n" * (n + 1)})
    own = {"r": repo.path}
    rows = lambda t: sorted(map(tuple, gitlog.read(spark, t, own).collect()), key=str)
    whole = {t: rows(t) for t in ("commits", "changes", "diff_lines")}
    assert len(whole["commits"]) == len(whole["changes"]) == 7 and len(whole["diff_lines"]) == 28
    reader = gitlog.GitReader({"path": repo.path, "table": "commits"})
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(gitlog, "SPAN", 3)
    assert [(p.skip, p.last) for p in reader.partitions()] == [(0, False), (3, False), (6, True)]
    got = sorted((tuple(["r", *row[1:]]) for p in reader.partitions() for row in reader.read(p)), key=lambda r: r[2])
    assert [r[1] for r in got] == [r[1] for r in sorted(whole["commits"], key=lambda r: r[2])] and [r[2] for r in got] == list(range(7))
    for t in ("changes", "diff_lines"):
        reader = gitlog.GitReader({"path": repo.path, "table": t})
        assert sorted((("r", *row[1:]) for p in reader.partitions() for row in reader.read(p)), key=str) == whole[t]


def test_merge_ranges_agree_with_git(spark, repo):
    repo.commit("init", a="0")
    for n in range(3):
        repo("checkout", "-q", "-b", f"b{n}")
        for k in range(n + 1):
            repo.commit(f"b{n} {k}", **{f"b{n}{k}": "x"})
        repo("checkout", "-q", "main")
        repo.commit(f"main {n}", **{f"m{n}": "x"})
        repo.day += 1
        repo("merge", "-q", "--no-ff", "-m", f"merge {n}", f"b{n}")
    own = {"r": repo.path}
    key = lambda df: sorted((r.merge_sha, r.base_sha, r.sha) for r in df.collect())
    ours = key(merge_ranges(gitlog.read(spark, "commits", own)))
    assert ours == key(gitlog.read(spark, "merges", own)) and len(ours) == 2 + 3 + 4
    m = analyze_repository(spark, repo.path, cfg=Config(auto_specificity=False))
    assert m["strategy"] == "merge-boundary" and sum(len(c["commits"]) for c in m["candidates"]) == 9
    assert "strategy: merge-boundary" in report(m)


def test_squash_repository(spark, repo):
    repo.commit("docs: readme (#1)", **{"README.md": "x"})
    repo.commit("feat: add kafka bus (#12)", **{"services__bus.ts": "1", "package.json": '{"kafka": "1"}'})
    repo.commit("chore: tidy (#13)", **{"x.cfg": "1"})
    repo.commit("feat: kafka consumer (#18)", **{"services__bus.ts": "2", "services__consumer.ts": "1"})
    m = analyze_repository(spark, repo.path)
    assert m["strategy"] == "squash-boundary"
    by = {tuple(c["subjects"]): c for c in m["candidates"]}
    both = by["feat: add kafka bus (#12)", "feat: kafka consumer (#18)"]
    assert both["classification"] == "architectural" and both["range"] is None and "file:services/bus.ts" in both["merge_reasons"] and "token:feat" in both["merge_reasons"]
    assert by["docs: readme (#1)",]["classification"] == "skip" and by["docs: readme (#1)",]["range"][0] == gitlog.V.EMPTY_TREE
    assert [c["id"] for c in m["candidates"]] == ["C1", "C2", "C3"]


def test_scopes_and_halts(spark, repo):
    a = repo.commit("one", **{"src__pay__a.py": "1"})
    repo.commit("two", **{"src__auth__b.py": "1"})
    assert analyze_repository(spark, repo.path, "since:nope")["halt"] == "bad_ref"
    m = analyze_repository(spark, repo.path, f"since:{a}")
    assert [c["subjects"] for c in m["candidates"]] == [["two"]] and m["preflight"]["commit_count"] == 1
    m = analyze_repository(spark, repo.path, code="module:src/pay")
    assert [c["subjects"] for c in m["candidates"]] == [["one"]] and m["preflight"]["output_dir"] == "src/pay/docs/decisions"
    assert "src" in gitlog.source_roots(repo.path)


def test_records_in_the_tree(spark, repo):
    text = "---\ntype: workaround\n---\n## Evidence\n- x <!-- evidence: 1234567 marker:\"HACK: y\" -->\n"
    repo.commit("w", **{"docs__decisions__0007-x.md": text, "docs__decisions__note.md": text, "a.py": "# HACK: z\n"})
    found = gitlog.records(spark, repo.path)
    assert [r.path for r in found.collect()] == ["docs/decisions/0007-x.md"]
    tree = gitlog.read(spark, "worktree", {"r": repo.path}).select("path", "line")
    assert [len(r.findings) for r in citations.lifecycle(found, tree).collect()] == [1]
    assert gitlog.next_record_number(repo.path, "docs/decisions") == 8


def test_commands(spark, repo, capsys, tmp_path_factory):
    from histolith.__main__ import main

    sha = repo.commit("use x instead of y", **{"src__a.py": "# HACK: y\n"})
    away = tmp_path_factory.mktemp("away")
    record = away / "r.md"
    record.write_text(f"## Considered Options\n- y <!-- evidence: {sha[:9]} added:src/a.py -->\n")
    runner = away / "run.sh"
    runner.write_text('#!/bin/sh\ncat > /dev/null\necho \'so {"options": [{"option": "y", "verdict": "evidenced", "evidence": "e"}]} there\'\n')
    lookup = away / "state.sh"
    lookup.write_text("#!/bin/sh\necho closed\n")
    for f in (runner, lookup):
        f.chmod(0o755)

    def run(*args):
        code = main([str(a) for a in args])
        got = capsys.readouterr()
        return code, got.out, got.err

    code, out, err = run("verify", record, "--repo", repo.path, "--json")
    assert code == 0 and json.loads(out)[0]["verdicts"][0]["status"] == "verified" and "citations verified unscoped" in err
    code, out, err = run("verify", record, "--repo", repo.path, "--commits", sha)
    assert code == 0 and "unscoped" not in err and "kept: 1" in out
    assert run("verify", record, "--repo", repo.path, "--commits", "f" * 40)[0] == 1
    code, out, _ = run("judge-options", record, "--repo", repo.path, "--commits", sha, "--runner", runner, "--runs", 2, "--json")
    verdict = json.loads(out)
    assert code == 0 and verdict["overall"] == "pass" and verdict["runs"] == 2 and verdict["options"][0]["verdict"] == "evidenced"
    assert run("judge-options", record, "--runner", "false")[0] == 1
    url = "https://github.com/o/p/issues/7"
    repo.commit("w", **{"docs__decisions__0001-x.md": f'---\ntype: workaround\n---\n## Evidence\n- x {url} <!-- evidence: {sha[:9]} marker:"HACK: y" -->\n'})
    assert run("check-workarounds", repo.path, "--strict")[0] == 0
    code, out, _ = run("check-workarounds", repo.path, "--strict", "--json", "--check-upstream", lookup)
    assert code == 1 and json.loads(out)["flagged"] == 1 and url in out
    assert run("check-workarounds", repo.path, "--strict", "--check-upstream", "/nowhere/x")[0] == 0
    assert "commit " + sha in run("evidence", repo.path, "--commits", sha[:8])[1]
