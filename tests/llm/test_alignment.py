"""Tokenizer alignment against brute force, and the perfect hash beneath it."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment, perfect

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def byte_alphabet():
    """Bytes of the characters that a byte-level vocabulary is written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens(texts):
    """(id, start, end) of both tokenizers on whole texts; None where their bytes aren't the text's."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = byte_alphabet()
    for t in texts:
        if not t:
            yield None
            continue
        raw = b" " + t.encode()
        e = a.encode(" " + t, add_special_tokens=False)
        sides = [[(i, bytes(letters[c] for c in x)) for i, x in zip(e.ids, e.tokens)]]
        ids = b.encode(t)
        sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in ids for p in [b.id_to_piece(i)]])
        if any(b"".join(x for _, x in s) != raw for s in sides):
            yield None
            continue
        out = []
        for s in sides:
            at, spans = 0, []
            for i, x in s:
                spans.append((i, at, at + len(x)))
                at += len(x)
            out.append(spans)
        yield out


def brute(rows):
    both = list(tokens([t for _, t in rows]))
    links = [[(x[0], y[0]) for x in d[0] for y in d[1] if x[1] < y[2] and y[1] < x[2]] if d else [] for d in both]
    count = Counter(p for ls in links for p in ls)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (doc_id, _), d, ls in zip(rows, both, links):
        groups, sha = 0, ""
        if d:
            ends = sorted({e for _, _, e in d[0]} & {e for _, _, e in d[1]})
            groups, parts, low = len(ends), [], 0
            for e in ends:
                parts.append("|".join(",".join(str(i) for i, x, y in s if low <= x and y <= e) for s in d))
                low = e
            sha = hashlib.sha256(";".join(parts).encode()).hexdigest()
        out.append((doc_id, *(len(s) for s in d or ((), ())), groups, len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), sha))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(2)
    words = ["the", "Unterschied", "naïve,", "don't", "x=1;", "漢字かな", "😀", "é", "12,345.67", "<s>", "</s>", "<|endoftext|>", "<unk>", "aaaaaaaaaaaa", " ", " ", "\x00", "\x1c", "\x85", "İstanbul", "ﬁn", "　", "​", "'ll", "THE"]
    gaps = [" ", " ", " ", "  ", "\n", "\t", " \n ", "", "   "]
    texts = ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(1, 30))) for _ in range(150)]
    texts += [r.choice(gaps) + "".join(chr(r.choice([r.randrange(1, 128), r.randrange(160, 0x2FFF), r.randrange(0x4E00, 0x9FFF), r.randrange(0x1F300, 0x1F6FF)])) for _ in range(r.randrange(60))) for _ in range(100)]
    return [*texts, None, "", " ", "  ", "\n", "a", " a ", "low ▁ line", "▁", "a ▁", *texts[:20]]


@pytest.mark.parametrize("small", [False, True], ids=["whole", "blocks"])
def test_alignment_against_brute_force(documents, monkeypatch, small):
    if small:  # many hand-overs, salts and blocks
        for name, value in (("UNITS", 5), ("BLOCK_PAIRS", 300), ("FAN", 2), ("TEXT_CHARS", 40), ("TASK_PAIRS", 10), ("BUCKETS", 16)):
            monkeypatch.setattr(alignment, name, value)
    rows = list(enumerate(corpus()))
    got = alignment.align_corpus(documents(rows, 9), A, B).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_long_text_null_ids_and_an_empty_table(documents):
    text = "longer words, and " * 120_000
    rows = [(1, text), (None, "words and"), (2, "words and"), (2, "words and"), (3, None)]
    got = {(r["doc_id"], r["n_a"], r["n_links"]): r for r in alignment.align_corpus(documents(rows), A, B).collect()}
    (one,) = [r for k, r in got.items() if k[0] == 1]
    a = alignment.byte_level(A)[0](" " + text)
    assert one["n_a"] == len(a) and one["n_b"] == len(sentencepiece.SentencePieceProcessor(model_file=B).encode(text))
    groups = alignment.Aligner(A, B, True)
    of, _ = groups.units([text])
    assert one["groups_sha256"] == hashlib.sha256(";".join(groups.groups[u] for u in of).encode()).hexdigest()
    assert len(got) == 4 and got[(3, 0, 0)]["groups_sha256"] == ""
    assert alignment.align_corpus(documents(rows).limit(0), A, B).collect() == []


def test_byte_lengths_and_ids_are_those_of_the_file():
    encode, lengths = alignment.byte_level(A)
    a = Tokenizer.from_file(A)
    letters = byte_alphabet()
    vocab = a.get_vocab(with_added_tokens=False)
    assert all(lengths[i] == len(t) and all(c in letters for c in t) for t, i in vocab.items() if t != "<|endoftext|>")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert all(lengths[int(n)] == len(base64.b64decode(t)) for t, n in map(bytes.split, f))
    assert list(encode(" two words")) == a.encode(" two words").ids


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    bucket = perfect.bucket_of(keys, 7)
    built = [(b, *perfect.build(keys[bucket == b])) for b in range(7)]
    index = perfect.Index([b for b, _, _ in built], [s for _, s, _ in built], [w for _, _, w in built], 7)
    assert sorted(index(keys).tolist()) == list(range(len(keys)))
    other = index(np.arange(1 << 41, (1 << 41) + 500))
    assert ((other >= -1) & (other < max(1, len(keys)))).all()
