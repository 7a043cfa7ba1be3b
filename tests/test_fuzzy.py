"""Fuzzy joins against every pair's own ratio, and how many pairs are left for it."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import sequences
from lodestone.operators import fuzzy


def brute(queries, names, least):
    out = []
    for i, q in queries:
        for n in names:
            if q and n:
                r = round(SequenceMatcher(None, q.lower(), n.lower()).ratio(), 6)
                if r > least:
                    out.append((i, n, r))
    return sorted(out)


def perturbed(r, name):
    name = list(name)
    for _ in range(r.randrange(3)):
        at = r.randrange(len(name)) if name else 0
        r.choice((lambda: name.insert(at, r.choice("aeä7")), lambda: name[at : at + 1] and name.pop(at), lambda: name.__setitem__(slice(at, at + 1), [r.choice("xyz")])))()
    return "".join(name)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.75, 0.8, 0.9, 0.97])
def test_fuzzy_match_against_every_pair(spark, least):
    r = random.Random(int(least * 100))
    parts = ["Anna", "Bo", "Müller", "Customer#", "of", "the", "Lee", "Nordlicht", "GmbH", "X"]
    names = [" ".join(r.choices(parts, k=r.randrange(1, 5))) + str(r.randrange(100)) for _ in range(60)] + ["a", "ab", "AB", "abc", "aaaa", "aaaab", "bob", "Bob", "", None]
    queries = [(i, perturbed(r, n)) for i, n in enumerate(names) if n is not None] + [(900, None), (901, ""), (902, "a"), (903, "aaaaa"), (904, "bbo"), (905, "bbo"), (906, "l'x" * 90)]
    want = brute(queries, names, least)
    for by in ("grams", "bags"):
        got = fuzzy.fuzzy_match(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame([(n,) for n in names], "name string"), least, by)
        assert got.columns == ["query_id", "query", "name", "ratio"]
        assert sorted(tuple(x) for x in got.select("query_id", "name", "ratio").collect()) == want


def test_few_pairs_are_left_to_compare(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300)]
    names = [f"{a} {b}" for a, b in zip(r.choices(words, k=600), r.choices(words, k=600))]
    queries = [perturbed(r, n) for n in names]
    frame = lambda texts: spark.createDataFrame([(t,) for t in set(texts) if t], "_t string")
    met = {by: fuzzy.candidates(frame(queries), frame(names), 0.8, by).count() for by in ("grams", "bags")}
    near = lambda q, n: (lambda m: m.quick_ratio() > 0.8 and m.ratio() > 0.8)(SequenceMatcher(None, q, n))
    matching = len({(q, n) for q in queries for n in names if near(q, n)})
    assert all(matching <= m < len(queries) * len(names) / 20 for m in met.values())
    assert met["grams"] <= met["bags"]


def test_bag_bound_is_an_upper_bound(spark):
    r = random.Random(8)
    pairs = [("".join(r.choices("abcä ", k=r.randrange(1, 12))), "".join(r.choices("abcä ", k=r.randrange(1, 12)))) for _ in range(200)]
    for x in spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.bag_bound(F.col("a"), F.col("b")).alias("v")).collect():
        assert abs(x["v"] - SequenceMatcher(None, x["a"], x["b"]).quick_ratio()) < 1e-9


def test_best_matches_and_empty_tables(spark):
    names = spark.createDataFrame([("Anna Lee",), ("Anna Lea",), ("Bo",)], "name string")
    queries = spark.createDataFrame([(1, "ana lee"), (2, "zzz")], "query_id int, query string")
    assert [(x["query_id"], x["name"], x["rank"]) for x in fuzzy.best_matches(queries, names, 0.6).collect()] == [(1, "Anna Lee", 1)]
    assert fuzzy.fuzzy_match(queries.limit(0), names).count() == 0 and fuzzy.fuzzy_match(queries, names.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fuzzy.fuzzy_match(queries, names, 1.5)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.8, 0.9, 0.97])
def test_fuzzy_match_by_what_is_left_of_short_names(spark, least):
    r = random.Random(7)
    names = [f"Customer#{r.randrange(3000):09d}" for _ in range(150)] + ["a", "ab", "aab", "Anna Lee", "x" * 300, "x" * 299 + "y", ""]
    queries = [(i, perturbed(r, n)) for i, n in enumerate(names)]
    got = fuzzy.fuzzy_match(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame([(n,) for n in names], "name string"), least)
    assert sorted(tuple(x) for x in got.select("query_id", "name", "ratio").collect()) == brute(queries, names, least)


def test_names_of_like_digits_leave_few_pairs(spark):
    """Numbered names share their grams and characters; those left to compare are near in order too."""
    r = random.Random(5)
    names = [f"customer#{i:09d}" for i in r.sample(range(100_000), 2000)]
    queries = [n[: i % 8] + n[i % 8 + 1 :] for i, n in enumerate(names)]
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "_t string")
    left = {by: fuzzy.candidates(frame(queries), frame(names), 0.9, by).count() for by in (None, "bags")}
    assert left[None] < left["bags"] / 4


def test_ratios_of_a_batch_of_pairs_are_those_of_difflib():
    r = random.Random(4)
    for letters in ("ab", "abcä", "01 2ü€😀", "ab#01234"):
        a, b = (["".join(r.choices(letters, k=r.randrange(30))) for _ in range(300)] + more for more in (["x" * 210, "ab" * 120, ""], ["x" * 209 + "y", "ba" * 110, ""]))
        want = [round(SequenceMatcher(None, p, q).ratio(), 6) for p, q in zip(a, b)]
        assert sequences.ratios(pa.array(["before", *a]).slice(1), pa.array(b)).to_pylist() == want
    none = pa.Array.from_buffers(pa.string(), 0, [None, pa.py_buffer(b""), pa.py_buffer(b"")])
    assert sequences.ratios(none, none).to_pylist() == []


def test_a_pair_has_one_first_text_in_common():
    r = random.Random(6)
    for _ in range(100):
        a, b = ("".join(r.choices("01ä", k=r.randrange(1, 9))) for _ in range(2))
        k = r.randrange(1, min(len(a), len(b)) + 1)
        left, right = ({"".join(c) for c in combinations(t, k)} for t in (a, b))
        texts = sorted(left | right | {"q" * k})
        told = [t for t, v in zip(texts, sequences.ratios(pa.array([a] * len(texts)), pa.array([b] * len(texts)), pa.array(texts)).to_pylist()) if v is not None]
        assert len(told) == bool(left & right) and set(told) <= left & right


def test_pairs_of_short_names_go_through_no_exchange(spark):
    """Pairs are many times the names: they get their ratio where they meet, and rows that come twice match twice."""
    names = ["Customer#000000011", "Customer#000000101", "Customer#000000101", "customer#000000101"]
    queries = [(1, "Cutomer#000000011"), (2, "Cutomer#000000011"), (2, "Cutomer#000000011"), (3, "CUSTOMER#00000011")]
    got = fuzzy.fuzzy_match(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame([(n,) for n in names], "name string"), 0.9)
    assert sorted(tuple(x) for x in got.select("query_id", "name", "ratio").collect()) == brute(queries, names, 0.9)
    over = got._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[0]
    assert not any(node in over for node in ("Join", "Aggregate", "Repartition", "Sort"))
