"""Fuzzy joins of names: a bound on the ratio finds the pairs, the ratio itself is computed for those alone."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences
from ..sources.store import written

#: Length of the longest grams.
MAX_Q = 3
#: Pairs whose ratio a task computes, about.
TASK_PAIRS = 20_000
#: Texts that a task cuts short.
TASK_TEXTS = 5_000
#: Texts that a text becomes at most by leaving out characters, where pairs are found by these.
MAX_VARIANTS = 256
#: Ratios are rounded to six places, so that one this much below a threshold can come out above it.
ROUNDING = 1e-6


def ratio(a: Column, b: Column, common: Column | None = None) -> Column:
    """Ratcliff-Obershelp similarity of two texts as they are, to six places.

    With ``common``, a text that is left of both when characters are left out, it is null but for the first such text
    of its length: a pair that meets on all of them is told once.
    """

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return sequences.ratios(x, y)

    def once(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        return sequences.ratios(x, y, z)

    # As if it were random: else a condition on it is pushed down as a second call.
    columns = [a, b] if common is None else [a, b, common]
    return F.arrow_udf(run if common is None else once, "double").asNondeterministic()(*columns)


def gram_length(least: float) -> int:
    """The longest grams of which pairs above ``least`` must share more, the longer they are."""
    low = least - ROUNDING
    return max((q for q in range(1, MAX_Q + 1) if low / 2 > (1 - low) * (q - 1) + 0.05 or q == 1))


def short(least: float, q: int) -> int:
    """Texts of this many characters or fewer may have no ``q``-gram in common with a partner."""
    low = least - ROUNDING
    return math.floor((q - 1) * (2 - low) / (low - 2 * (1 - low) * (q - 1)) + ROUNDING)


def shared(length: Column, least: float, q: int) -> Column:
    """How many ``q``-grams a text of this length shares at least with any partner of a ratio above ``least``.

    Of lengths a and b, M characters match in at most a + b - 2M + 1 blocks, and a block of m characters holds
    m - q + 1 grams. M is more than least * (a + b) / 2, and the shortest partner has a * least / (2 - least).
    """
    low = least - ROUNDING
    return F.greatest(F.lit(1), F.ceil(2 * length / (2 - low) * (low / 2 - (1 - low) * (q - 1)) - (q - 1) - ROUNDING).cast("int"))


def _prefixes(texts: DataFrame, counts: DataFrame | None, least: float, q: int) -> tuple[DataFrame, DataFrame]:
    """``_t, token`` of the rarest ``q``-grams of each text, one of which any partner has among its own; and the counts
    of all grams. A gram that a text has twice counts as two different ones."""
    n = F.length("_t") - q + 1
    grams = texts.where(n > 0).select("_t", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("_t"), i, F.lit(q)))).alias("g"))
    tokens = grams.groupBy("_t", "g").agg(F.count("*").cast("int").alias("n")).select("_t", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.col("g"), i.cast("string")))).alias("token"))
    if counts is None:
        counts = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(counts, "token", "left").groupBy("_t").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("all"))
    kept = F.slice("all", F.lit(1), F.greatest(F.lit(1), F.size("all") - shared(F.length("_t"), least, q) + 1))
    return ranked.select("_t", F.explode(kept["token"]).alias("token")), counts


def bag_bound(a: Column, b: Column) -> Column:
    """An upper bound of the ratio: characters in common, each as often as both have it."""
    one = F.array_distinct(F.split(a, ""))
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(one, F.lit(0), lambda s, c: s + F.least(times(a, c), times(b, c)))
    return 2 * common / (F.length(a) + F.length(b))


def _meetings(left: DataFrame, right: DataFrame) -> int:
    """Rows of the join of two sets of prefixes, from counts by token."""
    n = [side.groupBy("token").agg(F.count("*").alias(c)) for side, c in ((left, "a"), (right, "b"))]
    return n[0].join(n[1], "token").agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0))).first()[0]


def _met(channels: list[tuple[DataFrame, DataFrame]], least: float) -> DataFrame:
    """``q, n``, distinct: texts that share a token of their prefixes, and whose lengths and characters allow ``least``."""
    low, a, b = least - ROUNDING, F.length("q"), F.length("n")
    found = None
    for left, right in channels:
        pairs = left.withColumnRenamed("_t", "q").join(right.withColumnRenamed("_t", "n"), "token").where(2 * F.least(a, b) > low * (a + b)).select("q", "n")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct().where(bag_bound(F.col("q"), F.col("n")) > low)


def _prefix_pair(queries: DataFrame, names: DataFrame, least: float, q: int) -> tuple[DataFrame, DataFrame]:
    right, counts = _prefixes(names, None, least, q)
    return written(_prefixes(queries, counts, least, q)[0], "grams"), written(right, "grams")


def cuts(least: float) -> list[tuple[int, int, int]]:
    """Lengths a and b of two texts, and the least characters they have in common, in order, at a ratio above ``least``:
    where either text becomes at most ``MAX_VARIANTS`` others when it is cut to these."""
    low, out = least - ROUNDING, []
    for a in range(1, MAX_VARIANTS + 1):
        for b in range(max(1, math.ceil(a * low / (2 - low) - ROUNDING)), min(MAX_VARIANTS, math.floor(a * (2 - low) / low + ROUNDING)) + 1):
            k = max(1, math.ceil(low * (a + b) / 2 - ROUNDING))
            if k <= min(a, b) and max(math.comb(a, k), math.comb(b, k)) <= MAX_VARIANTS:
                out.append((a, b, k))
    return out


def _shortened(texts: DataFrame, text: str, to: DataFrame, most: int) -> DataFrame:
    """The rows of ``texts`` with ``_cut``, the different texts that are left of their ``text`` when it is cut to ``_k``
    characters, and the lengths ``_a`` and ``_b`` of the pairs it is cut for. ``to``: _length, _a, _b, _k; ``most``
    characters are left out at most."""

    def without(n: int, begin: Column, start: Column) -> Column:
        """``begin`` and the text from ``start`` on, ``n`` of its characters left out."""
        if not n:
            return F.array(F.concat(begin, F.substring(text, start, F.col("_length"))))
        return F.flatten(F.transform(F.sequence(start, F.col("_length") - n + 1), lambda i: without(n - 1, F.concat(begin, F.substring(text, start, i - start)), i + 1)))

    rows, out = texts.withColumn("_length", F.length(text)).join(F.broadcast(to), "_length"), None
    for n in range(most + 1):
        part = rows.where(F.col("_length") - F.col("_k") == n).withColumn("_cut", F.array_distinct(without(n, F.lit(""), F.lit(1))))
        out = part if out is None else out.unionByName(part)
    return out.drop("_length", "_k")


def _near(left: DataFrame, right: DataFrame, lengths: DataFrame, most: int) -> DataFrame:
    """Rows of ``left`` (_q, a text, and others) and ``right`` (_n and others) whose texts have the ``lengths`` (a, b, k)
    and k characters in common, in order; with their ``ratio``, each pair of rows once.

    They meet on the hash of what is left of both, and a pair that meets more than once is told at the first of these
    texts, so that pairs go through no exchange. Each row of ``right`` has a hash once, so no pair is told twice.
    """
    token = lambda v: F.xxhash64("_a", "_b", v)
    to = lambda c: lengths.select(F.col(c).alias("_length"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("k").alias("_k"))
    # No text has none left; an inner explode would filter by that before the rows are dealt out, and make all texts twice.
    left = _shortened(left, "_q", to("a"), most).withColumn("_cut", F.explode_outer("_cut")).withColumn("_token", token(F.col("_cut"))).drop("_a", "_b")
    right = _shortened(right, "_n", to("b"), most).withColumn("_token", F.explode_outer(F.array_distinct(F.transform("_cut", token)))).drop("_a", "_b", "_cut")
    met = left.join(right, "_token").withColumn("ratio", ratio(F.col("_q"), F.col("_n"), F.col("_cut")))
    return met.where("ratio IS NOT NULL").drop("_token", "_cut")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of little size and much work: dealt to tasks by their number, not by bytes."""
    return rows.repartition(1 + rows.count() // TASK_TEXTS)


def _lengths(queries: DataFrame, names: DataFrame, least: float) -> tuple[DataFrame, DataFrame, int]:
    """Lengths of the texts (``_t``) that may be pairs: ``a, b, k`` of those that meet by what is left of them, ``a, b`` of
    the others, and the most characters that are left out."""
    short_ones, low = cuts(least), least - ROUNDING
    near = queries.sparkSession.createDataFrame(short_ones, "a int, b int, k int")
    own = [side.select(F.length("_t").alias(c)).distinct() for side, c in ((queries, "a"), (names, "b"))]
    met = F.broadcast(written(own[0].join(own[1], 2 * F.least("a", "b") >= low * (F.col("a") + F.col("b")) - ROUNDING).join(F.broadcast(near), ["a", "b"], "left"), "lengths"))
    return met.where("k IS NOT NULL"), met.where("k IS NULL").select("a", "b"), max((max(a, b) - k for a, b, k in short_ones), default=0)


def candidates(queries: DataFrame, names: DataFrame, least: float, by: str | None = None) -> DataFrame:
    """``q, n``: pairs of distinct lower-cased texts (``_t``) whose common characters allow a ratio above ``least``.

    Texts that become few others when they are cut to the characters which a pair of their lengths must have in common
    in order (``cuts``) meet on one of these, whatever grams they share: work grows with the texts and the pairs that
    are near. Pairs of other lengths meet as ``_by_tokens`` tells; with ``by`` all pairs do.
    """
    if by is not None:
        return _by_tokens(queries, names, least, by)
    near, other, most = _lengths(queries, names, least)
    found = _near(queries.withColumnRenamed("_t", "_q"), names.withColumnRenamed("_t", "_n"), near, most).select(F.col("_q").alias("q"), F.col("_n").alias("n"))
    return found if other.isEmpty() else found.unionByName(_of_lengths(queries, names, other, least))


def _of_lengths(queries: DataFrame, names: DataFrame, lengths: DataFrame, least: float) -> DataFrame:
    """Pairs as in ``candidates``, of the ``lengths`` (a, b) alone, found by rare tokens."""
    of = lambda side, c: written(side.join(F.broadcast(lengths.select(c).distinct()), F.length("_t") == F.col(c), "left_semi"), "texts")
    rest = _by_tokens(of(queries, "a"), of(names, "b"), least)
    return rest.join(F.broadcast(lengths), (F.length("q") == F.col("a")) & (F.length("n") == F.col("b")), "left_semi")


def _by_tokens(queries: DataFrame, names: DataFrame, least: float, by: str | None = None) -> DataFrame:
    """Pairs as in ``candidates``, found by rare tokens.

    Two exact ways, the one of fewer meetings is taken unless ``by`` names it. ``grams``: texts meet on a rare gram;
    those too short for long grams, and those that such may be partners of, meet on single characters. ``bags``: texts
    of the same characters are one class, classes meet on a rare character, and only classes that are near enough
    bring their texts together; for names that share most of their grams. A frequent token is one key of the join,
    which Spark splits where it is skewed.
    """
    length, low = F.length("_t"), least - ROUNDING
    q = gram_length(least)
    bar = short(least, q) if q > 1 else 0
    ways = {}
    if by != "bags":
        channels = [(q, length > bar)] if q > 1 else []
        channels.append((1, F.lit(True) if q == 1 else length * low / (2 - low) <= bar))
        ways["grams"] = [_prefix_pair(queries.where(which), names.where(which), least, n) for n, which in channels]
    bag = F.array_join(F.array_sort(F.split("_t", "")), "")
    own = [side.select("_t", bag.alias("_bag")) for side in (queries, names)]
    if by != "grams":
        ways["bags"] = [_prefix_pair(*(side.select(F.col("_bag").alias("_t")).distinct() for side in own), least, 1)]
    way = by or min(ways, key=lambda w: sum(_meetings(*channel) for channel in ways[w]))
    met = _met(ways[way], least)
    if way == "grams":
        return met
    left, right = (side.select(F.col("_t").alias(c), F.col("_bag").alias("_" + c)) for side, c in zip(own, "qn"))
    classes = met.withColumnsRenamed({"q": "_q", "n": "_n"})
    return left.join(classes, "_q").join(right, "_n").select("q", "n")


def fuzzy_match(queries: DataFrame, names: DataFrame, least: float = 0.6, by: str | None = None) -> DataFrame:
    """Pairs of ``queries`` (query_id, query) and ``names`` (name) with a ``ratio`` above ``least``, case aside.

    Null and empty texts match nothing; a repeated row matches as often as it comes. Pairs of short texts (``cuts``) get
    their ratio where they meet; of other lengths, equal texts are compared once and pairs are written before.
    """
    if not 0 < least < 1:
        raise ValueError("least must be between 0 and 1")
    side = lambda rows, c: rows.select(F.lower(c).alias("_t")).where("_t <> ''").distinct()
    texts, found = (side(queries, "query"), side(names, "name")), None
    columns = [*queries.columns, *names.columns, "ratio"]
    if by is None:
        near, other, most = _lengths(*texts, least)
        times = names.where("name <> ''")
        times = times.groupBy("name").agg(F.count("*").alias("_times")) if names.columns == ["name"] else times.withColumn("_times", F.lit(1))
        met = _near(_spread(queries.where("query <> ''").withColumn("_q", F.lower("query"))), _spread(times.withColumn("_n", F.lower("name"))), near, most)
        found = met.where(F.col("ratio") > least).withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*columns)
        if other.isEmpty():
            return found
        pairs = _of_lengths(*texts, other, least)
    else:
        pairs = candidates(*texts, least, by)
    pairs = written(pairs, "pairs")
    # Pairs are small rows of much work: tasks by their number, not by bytes.
    pairs = pairs.repartition(1 + pairs.count() // TASK_PAIRS, F.xxhash64("n")).sortWithinPartitions("n")
    scored = pairs.withColumn("ratio", ratio(F.col("q"), F.col("n"))).where(F.col("ratio") > least)
    rest = queries.join(scored, F.lower("query") == F.col("q")).join(names, F.col("n") == F.lower("name")).select(*columns)
    return rest if found is None else found.unionByName(rest)


def best_matches(queries: DataFrame, names: DataFrame, least: float = 0.6, k: int = 1) -> DataFrame:
    """The ``k`` names of largest ratio a query, ties by name, with ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.col("ratio").desc(), "name")
    return fuzzy_match(queries, names, least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
