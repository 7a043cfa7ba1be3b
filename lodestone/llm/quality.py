"""Line-first cleaning: judge every line, remove the failures, then reject documents that lose too much text.

A line fails as

* navigation, if at least a fifth of its words are separators (``|``, ``>``, ``/``, bullets) and there are three or more;
* noise, if at least half of its words carry two or more symbols in a row out of ``#*$%&|<>``, or if it has
  ten words or more and at least half of them equal the word before;
* shouting, if it has eight letters or more, nine of ten are capitals and half of its words end in ``!``;
* boilerplate, if it is short (``BOILERPLATE_WORDS`` words) and holds one of ``BOILERPLATE``, or if it repeats an
  earlier line of the document;
* unpunctuated, if it has ``LONG_LINE`` words or more and no sentence end anywhere in it.

The rules are about form and hold for any language with spaces. Lines without a word are neither judged nor
counted. A document is kept if the base rules of the contract pass and the lines that are left hold at least
``MIN_LEFT`` of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "sign up", "log in", "subscribe now", "click here", "read more", "skip to content", "enable javascript", "powered by",
)
BOILERPLATE_WORDS = 25
LONG_LINE = 60
MIN_LEFT = 0.5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SYMBOLS = "#*$%&|<>"
_NOISY = re.compile(r"[#*$%&|<>]{2}")
_SEPARATORS = frozenset("| > / » • · - – — :: || >> ›".split())
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?…。！？:;]")
#: A line without any of these can't be navigation, noise by symbols or shouting.
_MARKED = re.compile(r"[#*$%&|<>/»•·–—:›!-]")


def line_failure(line: str, words: list[str], seen: bool) -> str | None:
    """The rule that a line with ``words`` fails, if any. ``seen``: an earlier line is equal."""
    n = len(words)
    if _MARKED.search(line):
        bars = sum(w in _SEPARATORS for w in words)
        if bars >= 3 and bars * 5 >= n:
            return "navigation"
        if sum(1 for w in words if _NOISY.search(w)) * 2 >= n:
            return "noise"
        if sum(w.endswith("!") for w in words) * 2 >= n:
            letters = [c for c in line if c.isalpha()]
            if len(letters) >= 8 and sum(map(str.isupper, letters)) * 10 >= 9 * len(letters):
                return "shouting"
    if n >= 10 and sum(map(eq, words, words[1:])) * 2 >= n:
        return "noise"
    if seen or n <= BOILERPLATE_WORDS and _PHRASES.search(line):
        return "boilerplate"
    if n >= LONG_LINE and not _SENTENCE_END.search(line):
        return "unpunctuated"
    return None


def repeated_words(words: list[str]) -> int:
    """Words inside five-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def judge(text: str | None, with_text: bool = False) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_left_words[, cleaned]``."""
    text = text or ""
    dup_lines = left = 0
    # str.split is the fast way, and the same where no other space occurs that it would split at.
    split = _WORD.findall if _OTHER_SPACE.search(text) else str.split
    words: list[str] = []
    seen: set[str] = set()
    good: list[str] = []
    for line in text.split("\n"):
        own = split(line)
        if not own:
            good.append(line)
            continue
        again = line in seen
        dup_lines += again
        seen.add(line)
        words += own
        if line_failure(line, own, again) is None:
            left += len(own)
            good.append(line)
    n_words, word_chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, _SYMBOLS))
    repeats = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * n_words
    out = (n_words, word_chars, symbols, dup_lines, repeats, failed, not failed and left >= MIN_LEFT * n_words, left)
    return (*out, "\n".join(good)) if with_text else out


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left_words")
_BOOLEAN = frozenset(_NAMES[5:7])


def clean_lines(docs: DataFrame, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` with the columns of ``judge`` (and ``cleaned_text`` if ``with_text``). One pass, no shuffle.

    Null text counts as empty: no words, so the base rules fail. Columns of ``docs`` with the names of the
    results are replaced; all other columns and all rows, repeated ones too, are kept as they are.
    """
    docs = docs.drop(*_NAMES, "cleaned_text")
    types = {n: pa.bool_() if n in _BOOLEAN else pa.int64() for n in _NAMES} | ({"cleaned_text": pa.string()} if with_text else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(x, with_text) for x in batch.column(text_col).to_pylist()]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *types])

    schema = T.StructType(list(docs.schema))
    for name in types:
        schema.add(name, T.BooleanType() if name in _BOOLEAN else T.StringType() if name == "cleaned_text" else T.LongType())
    return docs.mapInArrow(run, schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """The counts of the contract and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", *_NAMES)


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)
),
judged AS (
  SELECT doc_id, line, i, w, len(w) AS n,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
    len(list_filter(w, lambda x: x IN ('|','>','/','»','•','·','-','–','—','::','||','>>','›'))) AS bars,
    len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]{2}'))) AS noisy,
    len(list_filter(w, lambda x: ends_with(x, '!'))) AS loud,
    length(regexp_replace(line, '[^\p{L}]', '', 'g')) AS letters,
    length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) AS capitals,
    regexp_matches(line, '(?i)all rights reserved|terms of use|terms of service|privacy policy|cookie policy|use cookies|sign up|log in|subscribe now|click here|read more|skip to content|enable javascript|powered by') AS phrase,
    len(list_filter(w, lambda x, k: k > 1 AND x = w[k - 1])) AS stutters,
    regexp_matches(line, '[.!?…。！？:;]') AS ended
  FROM lines WHERE len(w) > 0
),
per_line AS (
  SELECT doc_id, sum(n) AS n_words,
    sum(CASE WHEN again THEN 1 ELSE 0 END) AS n_dup_lines,
    sum(CASE WHEN (bars >= 3 AND bars * 5 >= n) OR noisy * 2 >= n OR (n >= 10 AND stutters * 2 >= n) OR (loud * 2 >= n AND letters >= 8 AND capitals * 10 >= 9 * letters)
      OR again OR (n <= 25 AND phrase) OR (n >= 60 AND NOT ended) THEN 0 ELSE n END) AS n_left_words
  FROM judged GROUP BY doc_id
),
words AS (
  SELECT doc_id, word, i FROM (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs))
),
windows AS (
  SELECT doc_id, i, CASE WHEN lead(word, 4) OVER d IS NULL THEN NULL
    ELSE word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d END AS win
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
marked AS (
  SELECT doc_id, i, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 THEN 1 ELSE 0 END AS twice FROM windows
),
covered AS (
  SELECT doc_id, sum(c) AS n_repeat_words FROM (
    SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM marked)
  GROUP BY doc_id
),
counts AS (
  SELECT d.doc_id, coalesce(l.n_words, 0) AS n_words,
    length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
    coalesce(l.n_left_words, 0) AS n_left_words
  FROM docs d LEFT JOIN per_line l USING (doc_id) LEFT JOIN covered c USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * n_left_words >= n_words AS kept,
  n_left_words::BIGINT AS n_left_words
FROM counts
"""
