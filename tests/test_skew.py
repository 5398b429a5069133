import random

from histolith.operators.numbering import numbered
from histolith.operators.skewed_keys import first_last_per_key

SCHEMA = "key string, at int, id string, n int, last_id string"


def brute(data):
    out = {}
    for key in {r[0] for r in data}:
        own = {(r[1], r[2]) for r in data if r[0] == key}
        dated = sorted(x for x in own if x[0] is not None)
        out[key] = (len(own), *(dated[0] if dated else (None, None)), *(dated[-1] if dated else (None, None)))
    return out


def test_hot_key_spans_ranges_and_matches_brute_force(spark, rows):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.choice([None, *range(40)]), f"s{rng.randrange(200):03d}", 7, "x") for _ in range(3000)]
    data += data[:500] + [(None, 1, "a", 0, ""), (None, None, "b", 0, ""), ("undated", None, "z", 0, "")]
    df = rows(data, SCHEMA)
    parts = df.select("key", "at", "id").repartitionByRange(6, "key", "at", "id").rdd.glom().map(lambda p: {r.key for r in p}).collect()
    assert sum("hot" in p for p in parts) > 1
    got = {r.key: tuple(r)[1:] for r in first_last_per_key(df, 6).collect()}
    assert got == brute(data)


def test_empty(rows):
    assert first_last_per_key(rows([], SCHEMA)).collect() == []


def test_numbering_matches_window(rows):
    data = [("a" if i % 3 else "b", (i * 37) % 101, i) for i in range(300)] + [("c", None, 1), ("c", 5, 2)]
    got = {(r.g, r.i): r.n for r in numbered(rows(data, "g string, v int, i int"), ["g"], ["v", "i"], "n").collect()}
    for g in "abc":
        own = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [got[g, r[2]] for r in own] == list(range(1, len(own) + 1))


def test_numbering_with_null_group(rows):
    got = numbered(rows([(None, 2), (None, 1), ("a", 3)], "g string, v int"), ["g"], ["v"], "n").collect()
    assert {(r.g, r.v): r.n for r in got} == {(None, 1): 1, (None, 2): 2, ("a", 3): 1}
