"""The Parquet tables as contacts, deals, activities, request log and the like: one projection each, so that column
pruning and filters reach the scan. ``SQL`` holds the same projections for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deal_stage(status: Column, priority: Column) -> Column:
    """Pipeline stage of an order from its status and priority."""
    urgent = priority.isin("1-URGENT", "2-HIGH")
    return (
        F.when((status == "F") & (urgent | (priority == "3-MEDIUM")), "closed_won")
        .when(status == "F", "closed_lost")
        .when((status == "P") & urgent, "negotiation")
        .when(status == "P", "proposal")
        .when(urgent, "qualified")
        .otherwise("lead")
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("company"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select(
        F.col("c_custkey").alias("contact_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        "company",
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("deal_id"),
        F.concat(F.lit("Deal "), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_totalprice").alias("value"),
        deal_stage(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("stage"),
        F.col("o_orderdate").alias("close_date"),
        F.col("o_custkey").alias("contact_id"),
    )


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("activity_id"), F.col("event_type").alias("type"), F.col("props").alias("description"), F.col("ts").alias("date"), F.col("user_id").alias("contact_id")
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts"),
        F.col("user_id").cast("string").alias("ip"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("latency"),
    )


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request counters of each user's process by path and status, sampled at each request; they start over every day."""
    n = F.col("request_id")
    status = F.when(n % 11 == 0, 500).when(n % 7 == 0, 429).when(n % 5 == 0, 404).otherwise(200)
    log = request_log(spark, sf_dir).select(F.col("path").alias("service"), F.col("ip").alias("instance"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), "request_id", F.to_date("ts").alias("_day"))
    run = Window.partitionBy("service", "instance", "status", "_day").orderBy("at", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("service", "instance", "status", "at", F.sum(n % 3 + 1).over(run).alias("value"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that SQL can make too: the non-blank lines of each document."""
    at = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "content"))
    return at.where(F.trim("content") != "").select(
        (F.col("doc_id") * 100000 + F.col("line_no")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("line_no").alias("chunk_index"), "content"
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense entity graph: the brands (entities) of each order (document and chunk)."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_partkey")
    return item.join(part, F.col("l_partkey") == F.col("p_partkey")).select("chunk_id", "entity").distinct()


SQL = {
    "contacts": "contacts AS (SELECT c_custkey AS contact_id, c_name AS name, lower(c_name) || '@example.com' AS email, CAST(NULL AS VARCHAR) AS phone, n_name AS company FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)",
    "deals": """deals AS (SELECT o_orderkey AS deal_id, 'Deal ' || o_orderkey AS name, o_totalprice AS value,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'closed_won' WHEN o_orderstatus = 'F' THEN 'closed_lost'
       WHEN o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'negotiation' WHEN o_orderstatus = 'P' THEN 'proposal'
       WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'qualified' ELSE 'lead' END AS stage,
  o_orderdate AS close_date, o_custkey AS contact_id FROM orders)""",
    "activities": "activities AS (SELECT event_id AS activity_id, event_type AS type, props AS description, ts AS date, user_id AS contact_id FROM events)",
    "log": "log AS (SELECT event_id AS request_id, ts, user_id::VARCHAR AS ip, '/' || event_type AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS latency FROM events)",
    "samples": """samples AS (SELECT path AS service, ip AS instance, status, ts AS "at", sum(request_id % 3 + 1) OVER (PARTITION BY path, ip, status, ts::DATE ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING)::BIGINT AS value
  FROM (SELECT path, ip, ts, request_id, CASE WHEN request_id % 11 = 0 THEN 500 WHEN request_id % 7 = 0 THEN 429 WHEN request_id % 5 = 0 THEN 404 ELSE 200 END AS status FROM log))""",
    "messages": "messages AS (SELECT conv_id AS session_id, turn, role, text AS content FROM conversations)",
    "lines": """lines AS (SELECT doc_id * 100000 + i - 1 AS chunk_id, doc_id AS document_id, (i - 1)::INT AS chunk_index, content FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(content) <> '')""",
    "mentions": "mentions AS (SELECT DISTINCT l_orderkey AS chunk_id, p_brand AS entity FROM lineitem JOIN part ON l_partkey = p_partkey)",
}


def with_sql(query: str, *names: str) -> str:
    """``query`` with the projections ``names`` as common table expressions before it."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + query
