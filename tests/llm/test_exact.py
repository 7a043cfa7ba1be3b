"""Exact duplicates against brute force."""

import hashlib
import random
import re

import pytest

from lodestone.llm import exact


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for i, t in enumerate(norm):
        groups.setdefault(t, []).append(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        mine = groups[norm[i]]
        keep = min(mine, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
        raw = norm[i].encode()
        out.append((doc_id, rows[keep][0], len(mine), i == keep, hashlib.sha256(raw).hexdigest(), len(raw)))
    return sorted(out, key=repr)


def cases():
    r = random.Random(3)
    words = ["a", "bb", "ü", "漢字", "x y", "\x1f"]
    texts = ["".join(r.choice(words) + r.choice([" ", "  ", "\t\n", "\r", "\x0b\x0c"]) for _ in range(r.randrange(6))) for _ in range(150)]
    return [*texts, *r.sample(texts, 40), None, "", " ", "  ", "\n", "a", " a", "a ", "\xa0"]


@pytest.mark.parametrize("primes", [exact.PRIMES, (3, 2)], ids=["primes", "colliding"])
def test_groups_against_brute_force(spark, documents, monkeypatch, primes):
    monkeypatch.setattr(exact, "SALT_ROWS", 3)
    rows = list(enumerate(cases()))
    random.Random(1).shuffle(rows)
    got = exact.exact_duplicates(documents(rows), primes).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_equal_fingerprints_of_other_texts_are_told_apart(documents):
    # Modulo 2, "a" and "c" have the same hashes at equal lengths.
    rows = [(1, "a b"), (2, "c b"), (3, "a  b"), (4, "c\tb"), (5, "e b")]
    got = exact.exact_duplicates(documents(rows), (2, 2)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_long_texts_and_runs_across_slices(documents, monkeypatch):
    monkeypatch.setattr(exact, "SLICE", 64)
    monkeypatch.setattr(exact, "PIECE", 16)
    r = random.Random(5)
    long = ["".join(r.choice(["a", "b", " ", "  \n ", "é"]) for _ in range(n)) for n in (63, 64, 65, 200, 1000)]
    rows = list(enumerate([*long, *(re.sub(r"\s+", "\n\t", x) for x in long), long[-1][:-1] + "z", " " * 500, ""]))
    pieces = [b"".join(exact._stream(exact.np.frombuffer(t.encode(), exact.np.uint8))) for _, t in rows if t]
    assert pieces == [re.sub(rb"[\x20\x09-\x0D]+", b" ", t.encode()) for _, t in rows if t]
    monkeypatch.undo()
    big = "word  " * 200_000
    rows += [(100, big), (101, big.replace("  ", "\n")), (102, big[:-6] + "Word  ")]
    got = exact.exact_duplicates(documents(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_joined_pieces_have_the_hash_of_the_whole(spark):
    data = random.Random(2).randbytes(5000)
    cut = lambda n, data=data: spark.createDataFrame([(1, 1, k, "x", bytearray(data[i : i + n])) for k, i in enumerate(range(0, 5000, n))], exact._PIECES)
    prints = {tuple(exact.fingerprints(cut(n)).select("n", "f1", "f2").first()) for n in (5000, 1024, 7)}
    assert len(prints) == 1
    assert exact.fingerprints(cut(64, data[::-1])).first()["f1"] != next(iter(prints))[1]


def test_null_ids_repeated_rows_and_an_empty_table(documents):
    rows = [(None, "a b"), (3, "a  b"), (3, "a b"), (None, None), (7, "")]
    got = exact.exact_duplicates(documents(rows)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"]) == [(3, 3, 3, False), (3, 3, 3, True), (7, 7, 2, True)]
    assert exact.exact_duplicates(documents(rows).limit(0)).collect() == []
