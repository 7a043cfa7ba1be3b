"""Conversational memory (working, episodic, semantic, procedural) and wiki entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import embed, hashing_embedder
from ..functions.text import capital, clean_topics, shorten

MAX_WORKING, HISTORY, MIN_CONFIDENCE, TTL_DAYS = 10, 6, 0.3, 90


def last_messages(messages: DataFrame, keep: int = MAX_WORKING) -> DataFrame:
    """The ``keep`` newest messages of each session."""
    w = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def oldest_messages(messages: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("turn")
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def history_block(messages: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The last messages of each session as one text, long ones shortened to 150 characters."""
    line = F.concat(F.when(F.col("role") == "user", "**Q:** ").otherwise("**A:** "), shorten(F.col("content"), 150))
    each = last_messages(messages, keep).withColumn("line", line).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("m"))
    return each.select("session_id", F.concat(F.lit("\n---\n**Recent conversation:**\n"), F.array_join(F.col("m.line"), "\n")).alias("history"))


def session_summary(messages: DataFrame) -> DataFrame:
    """Message count and the first question of each session, shortened to 120 characters."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    each = messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.min_by("content", user).alias("first"), F.count(user).alias("asked"))
    text = F.when(F.col("asked") == 0, "Conversation with no recorded queries").otherwise(F.concat(F.lit("Conversation about: "), shorten(F.col("first"), 120)))
    return each.select("session_id", "message_count", text.alias("summary"))


def session_topics(messages: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` topic words of the user's messages in each session, sorted."""
    each = messages.where("role = 'user'").select("session_id", F.explode(clean_topics(F.col("content"), capital)).alias("topic")).distinct()
    w = Window.partitionBy("session_id").orderBy("topic")
    top = each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return top.groupBy("session_id").agg(F.array_sort(F.collect_list("topic")).alias("topics"))


def expire(rows: DataFrame, ts: str, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Rows not older than ``days`` before ``now``, which is passed in."""
    return rows.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def confident(facts: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    return facts.where(F.col("confidence") >= least)


def add_facts(facts: DataFrame, new: DataFrame, model=hashing_embedder) -> DataFrame:
    """``facts`` (id, fact, embedding, source, source_id, confidence) and the ``new`` ones, embedded. New facts need
    ``id`` and ``fact``; the source is a conversation and the confidence 1 unless given. A null fact has no embedding."""
    given = lambda c, default: F.coalesce(F.col(c), default) if c in new.columns else default
    rows = new.select(
        "id", "fact", F.when(F.col("fact").isNotNull(), embed(F.col("fact"), model)).alias("embedding"), given("source", F.lit("conversation")).alias("source"),
        given("source_id", F.lit(None).cast("string")).alias("source_id"), given("confidence", F.lit(1.0)).alias("confidence"),
    )
    return facts.unionByName(rows)


def clear(messages: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """``messages`` without those of ``sessions`` (session_id); without any of them if no sessions are given."""
    return messages.limit(0) if sessions is None else messages.join(sessions.select("session_id"), "session_id", "left_anti")


def cleared(messages: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """How many messages ``clear`` removes, as ``removed``."""
    gone = messages if sessions is None else messages.join(sessions.select("session_id"), "session_id", "left_semi")
    return gone.agg(F.count("*").alias("removed"))


def count_usage(procedures: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    added = uses.groupBy(key).agg(F.count("*").alias("_n"))
    return procedures.join(added, key, "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def with_topics(rows: DataFrame, topics: list[str], column: str = "topics") -> DataFrame:
    """Rows that have any of ``topics``."""
    return rows.where(F.arrays_overlap(column, F.array(*map(F.lit, topics))))


def reassemble(chunks: DataFrame) -> DataFrame:
    """Each document's chunks in order, with a blank line between them."""
    each = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    return each.select("document_id", F.array_join(F.col("c.content"), "\n\n").alias("text"), F.size("c").alias("chunks"))


def wiki_backfill(documents: DataFrame, wiki: DataFrame) -> DataFrame:
    """Documents that have no entry yet."""
    return documents.join(wiki.select("document_id"), "document_id", "left_anti")


def wiki_search(wiki: DataFrame, query: str) -> DataFrame:
    """Up to 50 newest entries whose summary matches, then those of the 100 newest with a matching topic."""
    q = query.strip()
    if not q:
        return wiki.limit(0).withColumn("match", F.lit(""))
    newest = [F.col("updated_at").desc(), "document_id"]
    by_summary = wiki.where(F.col("summary").ilike(f"%{q}%")).orderBy(*newest).limit(50)
    recent = wiki.orderBy(*newest).limit(100)
    by_topic = recent.where(F.exists("topics", lambda t: F.contains(F.lower(t), F.lit(q.lower())))).join(by_summary.select("document_id"), "document_id", "left_anti")
    return by_summary.withColumn("match", F.lit("summary")).unionByName(by_topic.withColumn("match", F.lit("topic")))
