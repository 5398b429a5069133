"""Operators on terms, baskets, sets and links against brute force on small tables with all kinds of dirt."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from histolith.llm.cooccurrence import PairTable, count_pairs
from histolith.llm.distinctive import distinctive_terms, most_distinctive
from histolith.llm.frequency import marks, term_frequencies
from histolith.llm.groups import connected_groups
from histolith.llm.setjoin import expanded, similar_sets

REC = "kind string, key string, terms array<string>, n int, id string, label string"


def dirty(n=400, seed=3, vocabulary=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 4, 5, 6, 8, 12])
        terms = [None if rng.random() < 0.05 else "hot" if rng.random() < 0.3 else f"t{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(size)]
        out.append((rng.choice("ab"), f"k{i:04d}", terms, 1, "x", None))
    return [*out, *out[:50], ("a", "none", None, 0, None, ""), ("a", "empty", [], 0, "", ""), ("a", "nulls", [None, None], 0, "", ""), ("b", "long", ["y" * 100_000, "hot"], 0, "", "")]


def records(data):
    """Distinct keys with their terms, nulls left out."""
    return {(k, key): [t for t in (terms or []) if t is not None] for k, key, terms, *_ in data}


def test_frequencies(rows):
    data = dirty()
    own = records(data)
    occ, rec = Counter(), Counter()
    for (kind, _), terms in own.items():
        occ.update((kind, t) for t in terms)
        rec.update((kind, t) for t in set(terms))
    total = Counter(kind for kind, _ in own)
    got = {(r.kind, r.term): (r.occurrences, r.records, r.total, r.mark) for r in marks(term_frequencies(rows(data, REC).repartition(5))).collect()}
    mark = lambda n, t: "rare" if n == 1 else "common" if n > 3 and n * 50 > t else None
    assert got == {k: (occ[k], rec[k], total[k[0]], mark(rec[k], total[k[0]])) for k in occ}


@pytest.mark.parametrize("f", [term_frequencies, distinctive_terms])
def test_no_records(rows, f):
    assert f(rows([], REC)).collect() == []


def test_distinctive(rows):
    data = dirty()
    own = records(data)
    df = Counter((kind, t) for (kind, _), terms in own.items() for t in set(terms))
    total = Counter(kind for kind, _ in own)
    got = {(r.kind, r.key, r.term): (r.tf, r.df, round(r.score, 9)) for r in distinctive_terms(rows(data, REC)).collect()}
    want = {}
    for (kind, key), terms in own.items():
        for t, tf in Counter(terms).items():
            d = df[kind, t]
            want[kind, key, t] = (tf, d, round(tf / len(terms) * (math.log((1 + total[kind]) / (1 + d)) + 1), 9))
    assert got == want
    best = {(r.kind, r.key): r.term for r in most_distinctive(distinctive_terms(rows(data, REC))).collect()}
    for (kind, key), terms in own.items():
        some = min(((df[kind, t], t) for t in set(terms) if df[kind, t] >= 2), default=(99, None))
        assert best.get((kind, key)) == (some[1] if some[0] <= 5 else None)


BASKET = "grp string, items array<string>, n int, id string"


def counted(baskets, most=None):
    pairs, items, n = Counter(), Counter(), Counter()
    for g, own, *_ in baskets:
        s = sorted({x for x in own or [] if x is not None})
        if not s or most and len(s) > most:
            continue
        n[g or ""] += 1
        items.update((g or "", x) for x in s)
        pairs.update((g or "", a, b) for a, b in combinations(s, 2))
    return {(g, a, b): (c, items[g, a], items[g, b], n[g]) for (g, a, b), c in pairs.items()}


def scores(t, **k):
    return {(r.grp, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in t.scores(**k).collect()}


def baskets(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["g", "h", None]), [rng.choice([None, "hot", *"abcdefgh"]) for _ in range(rng.randrange(9))], 0, "x") for _ in range(n)] + [("g", None, 0, ""), ("g", [], 0, "")]


def test_pairs_and_increments(spark, rows):
    old, extra = baskets(200, 1), baskets(60, 2)
    t = count_pairs(rows(old, BASKET), max_items=6, buckets=5)
    assert scores(t) == counted(old, 6)
    assert scores(t, min_joint=5, min_lift=1.5) == {k: v for k, v in counted(old, 6).items() if v[0] >= 5 and v[0] * v[3] >= 1.5 * v[1] * v[2]}
    # some baskets change, some go, some come
    t.merge(rows(extra, BASKET), rows(old[:80], BASKET))
    assert scores(t) == counted(old[80:] + extra, 6)
    again = PairTable.open(spark, t.path)
    assert again.version == t.version and scores(again) == scores(t)
    only = scores(t, affected=rows([("g",)], "grp string"))
    assert only == {k: v for k, v in scores(t).items() if k[0] == "g"}


def test_scores_are_refreshed_where_a_merge_touched(rows):
    old = baskets(200, 1)
    t = count_pairs(rows(old, BASKET))
    before = t.scores()
    kept = before.withColumn("n", F.col("n") + 1000)  # recognisable
    t.merge(rows([("g", ["a", "b"], 0, "x")] * 3, BASKET), rows([b for b in old if b[0] == "g"][:9], BASKET))
    assert [r.grp for r in t.touched.collect()] == ["g"]
    got = {(r.grp, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in t.refreshed(kept).collect()}
    left = list(old)
    for b in [b for b in old if b[0] == "g"][:9]:
        left.remove(b)
    want = counted(left + [("g", ["a", "b"])] * 3)
    assert {k: v for k, v in got.items() if k[0] == "g"} == {k: v for k, v in want.items() if k[0] == "g"}
    assert {k: v for k, v in got.items() if k[0] != "g"} == {k: (*v[:3], v[3] + 1000) for k, v in want.items() if k[0] != "g"}


def test_items_that_share_a_hash(spark, rows, monkeypatch):
    from histolith.llm import cooccurrence as C

    monkeypatch.setattr(C, "_hash", lambda salt, grp, item: F.pmod(F.xxhash64(salt, grp, item), F.lit(97)))
    old, extra = baskets(150, 4), [("g", ["a", "z1", "z2", "b"], 0, "x"), ("k", [*"abcdefgh"], 0, "x")] * 4
    t = count_pairs(rows(old, BASKET))
    assert t.salted and scores(t) == counted(old)
    t.merge(rows(extra, BASKET), rows(old[:40], BASKET))
    assert scores(t) == counted(old[40:] + extra) == scores(PairTable.open(spark, t.path))


def test_buckets_follow_from_the_size(rows, monkeypatch):
    from histolith.llm import cooccurrence as C

    old = baskets(100, 6)
    assert count_pairs(rows(old, BASKET)).buckets == 1
    monkeypatch.setattr(C, "PER_BUCKET", 100)
    t = count_pairs(rows(old, BASKET))
    assert t.buckets > 3 and scores(t) == counted(old)


def test_many_merges(spark, rows):
    """More merges than runs of a bucket, some of which take everything back."""
    sets = [baskets(30, 20 + k) for k in range(8)]
    t = count_pairs(rows(sets[0], BASKET), buckets=3)
    for new, old in zip(sets[1:], sets):
        t.merge(rows(new, BASKET), rows(old, BASKET))
        assert scores(t) == counted(new)
    assert max(len(runs) for runs in t.current["pairs"].values()) <= 4 and scores(PairTable.open(spark, t.path)) == counted(sets[-1])
    t.merge(None, rows(sets[-1], BASKET))
    assert scores(t) == {}


def test_lift_and_no_baskets(rows):
    r = count_pairs(rows([("g", ["a", "b"], 0, "")] * 3 + [("g", ["c"], 0, "")] * 3, BASKET)).scores().first()
    assert (r.lift, round(r.npmi, 9)) == (2.0, 1.0)
    assert count_pairs(rows([], BASKET)).scores().collect() == []


@pytest.mark.parametrize("num, den, least", [(6, 10, 4), (1, 2, 1), (9, 10, 1), (1, 1, 2), (1, 5, 1)])
def test_similar_sets(rows, num, den, least):
    data = dirty(250, 5, 25)
    sets = {k: frozenset(t) for k, t in records(data).items() if len(set(t)) >= least}
    want = {(a[0], *sorted((a[1], b[1]))) for a, b in combinations(sets, 2) if a[0] == b[0] and len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b])}
    pairs, classes, members = similar_sets(rows(data, REC).repartition(3), num, den, least)
    got = expanded(pairs, members).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    assert members.count() == len(sets)


def test_large_sets_and_no_sets(rows):
    base = [f"m{i}" for i in range(300)]
    data = [("a", "x", base, 0, "", ""), ("a", "y", base[:200] + ["q"], 0, "", ""), ("a", "z", base[:150], 0, "", "")]
    pairs, _, members = similar_sets(rows(data, REC))
    assert {(r.key_a, r.key_b) for r in expanded(pairs, members).collect()} == {("x", "y"), ("y", "z")}
    pairs, _, members = similar_sets(rows([], REC))
    assert expanded(pairs, members).collect() == []


def brute_groups(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops", "empty"])
def test_groups(rows, shape):
    rng = random.Random(9)
    edges = {
        "chain": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)],
        "star": [("c", f"l{i}") for i in range(150)] + [("c", f"l{i}") for i in range(150)],
        "random": [(f"v{rng.randrange(120)}", f"v{rng.randrange(120)}") for _ in range(80)] + [(None, "v1"), ("v2", None)],
        "loops": [("a", "a"), ("b", "c"), ("b", "b"), ("c", "b")],
        "empty": [],
    }[shape]
    got = connected_groups(rows([(a, b, "x", 1) for a, b in edges], "a string, b string, id string, grp int")).collect()
    assert len(got) == len({r.id for r in got}) and {r.id: r.grp for r in got} == brute_groups(edges)


def test_groups_of_numbers(rows):
    got = connected_groups(rows([(5, 3), (3, 9), (7, 8)], "a long, b long")).collect()
    assert {r.id: r.grp for r in got} == {3: 3, 5: 3, 9: 3, 7: 7, 8: 7}
