"""CRM queries and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import changes as H
from ..operators import crm as C
from ..operators import sync as Y
from ..operators import upsert as U
from ..sources import tables as T
from ..sources.store import new_path
from ..sources.tables import with_sql
from . import text as XQ

NOW = dt.datetime(2024, 1, 15)


def _c(s, d):
    return T.contacts(s, d)


def _delta_deals(s, d):
    """A second sync: every tenth deal again with a larger value, and new deals of contacts, some unknown."""
    base = T.deals(s, d)
    changed = base.where("deal_id % 10 = 0").withColumn("value", F.col("value") + 100.0)
    new = base.where("deal_id % 97 = 1").select((F.col("deal_id") + 10_000_000).alias("deal_id"), "name", "value", F.lit("lead").alias("stage"), "close_date", F.lit(-1).cast("bigint").alias("contact_id"))
    return changed.unionByName(new)


def _upsert_deals(s, d):
    base, delta = T.deals(s, d), _delta_deals(s, d)
    known = T.contacts(s, d).select("contact_id", F.col("contact_id").alias("new_fk"))
    old = base.select("deal_id", F.col("contact_id").alias("old_fk"))
    delta = delta.join(known, "contact_id", "left").join(old, "deal_id", "left").select("deal_id", "name", "value", "stage", "close_date", F.coalesce("new_fk", "old_fk").alias("contact_id"))
    out = U.upsert(base, delta, "deal_id")
    return out.groupBy("stage").agg(F.count("*").alias("n"), F.count("contact_id").alias("linked"), F.round(F.sum("value"), 2).alias("value"))


def _upsert_activities(s, d):
    base = T.activities(s, d)
    delta = base.where("activity_id % 5 = 0").withColumn("description", F.lit("updated"))
    extra = base.where("activity_id % 50 = 3").withColumn("activity_id", F.col("activity_id") + 10_000_000).withColumn("contact_id", F.lit(-1).cast("bigint"))
    known = T.contacts(s, d).select("contact_id", F.col("contact_id").alias("fk"))
    delta = delta.unionByName(extra).join(known, "contact_id", "left").drop("contact_id").withColumnRenamed("fk", "contact_id")
    return U.upsert(base, delta, "activity_id").groupBy("type").agg(F.count("*").alias("n"), F.count("contact_id").alias("linked"), F.count_if(F.col("description") == "updated").alias("updated"))


def _upsert_contacts(s, d):
    base = T.contacts(s, d)
    delta = base.where("contact_id % 7 = 0").withColumn("phone", F.lit("+1-555-0100"))
    return U.upsert(base, delta, "contact_id")


def _sync_status(s, d):
    runs = T.activities(s, d).where("type = 'purchase'").select(F.col("activity_id").alias("run_id"), F.when(F.col("activity_id") % 3 != 0, F.col("date")).alias("completed_at"))
    last = runs.orderBy(F.col("completed_at").desc_nulls_last(), "run_id").limit(1)
    counts = T.contacts(s, d).agg(F.count("*").alias("contacts")).join(T.deals(s, d).agg(F.count("*").alias("deals"))).join(T.activities(s, d).agg(F.count("*").alias("activities")))
    return counts.join(last)  # one row each


def _cross_refs(s, d):
    """All contacts with their companies and all parts with their last words, in all lines."""
    names = T.contacts(s, d).select("name", F.col("company").alias("db_match"))
    parts = T.table(s, d, "part").select(F.col("p_name").alias("name"), F.substring_index("p_name", " ", -1).alias("db_match"))
    return C.cross_references(names.unionByName(parts), T.lines(s, d))


def _bridge(s, d):
    old = T.contacts(s, d).where("contact_id % 2 = 0").select(F.concat(F.lit("Contact: "), "name").alias("filename"))
    out = C.new_documents(C.bridge_documents(T.contacts(s, d), T.deals(s, d), T.activities(s, d)), old)
    return out.select("source", "external_id", "title", "text")


def _contact_activities(s, d):
    """The events as kinds of activities, some of which concern contacts."""
    kind = F.when(F.col("type") == "view", "Call").when(F.col("type") == "click", "email").when(F.col("type") == "purchase", "meeting").otherwise("note")
    return T.activities(s, d).withColumn("type", kind)


def _sync_run(s, d):
    runs = s.createDataFrame([(1, "success", NOW, NOW, 1, 2, 3, None), (2, "error", NOW, NOW, None, None, None, "timeout")], Y.RUNS)
    delta = {"contacts": T.contacts(s, d).where("contact_id % 7 = 0"), "deals": _delta_deals(s, d), "activities": T.activities(s, d).where("activity_id % 5 = 0")}
    end = NOW + dt.timedelta(minutes=5)
    ended = Y.finish_run(Y.start_run(runs, 3, NOW), 3, end, delta)
    out = Y.finish_run(Y.start_run(ended, 4, end), 4, end, error="no route")
    return out.select("run_id", "status", F.unix_seconds("started_at").alias("started"), F.unix_seconds("completed_at").alias("completed"), "contacts_synced", "deals_synced", "activities_synced", "error_message")


def _sync_merge(s, d):
    base = {"contacts": T.contacts(s, d), "deals": T.deals(s, d), "activities": T.activities(s, d)}
    delta = {"contacts": base["contacts"].where("contact_id % 7 = 0").withColumn("phone", F.lit("+1-555-0100")), "deals": _delta_deals(s, d), "activities": base["activities"].where("activity_id % 5 = 0").withColumn("contact_id", F.lit(-1).cast("bigint"))}
    merged = Y.merge(base, delta)
    return merged["deals"].groupBy("stage").agg(F.count("*").alias("n"), F.count("contact_id").alias("linked"), F.round(F.sum("value"), 2).alias("value"))


def _next_snapshot(s, d):
    """A later state of the source: some deals changed, some gone, some new, one in thirteen without a stage."""
    base = T.deals(s, d)
    kept = base.where("deal_id % 17 <> 4").withColumn("value", F.when(F.col("deal_id") % 10 == 0, F.col("value") + 100.0).otherwise(F.col("value")))
    kept = kept.withColumn("stage", F.when(F.col("deal_id") % 13 != 1, F.col("stage")))
    return kept.unionByName(base.where("deal_id % 97 = 1").withColumn("deal_id", F.col("deal_id") + 10_000_000))


def _sync_diff(s, d):
    return H.diff(T.deals(s, d), _next_snapshot(s, d), "deal_id").select("deal_id", "stage", F.round("value", 2).alias("value"), "change")


def _sync_runs(s, d):
    """Three snapshots, the second delivered twice."""
    base, later = T.deals(s, d), _next_snapshot(s, d)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)
    table = H.SyncedTable(s, new_path(s, "deals"), kinds, "deal_id")
    for batch, rows in ((0, base), (1, later), (1, later), (2, base)):
        table.sync(rows, batch)
    return table.record()


def _accounts(s, d):
    c = T.contacts(s, d).select("contact_id", F.when(F.col("contact_id") % 3 == 0, F.col("name")).when(F.col("contact_id") % 3 == 1, "").alias("name"), F.concat(F.lit("  "), F.upper("email"), F.lit(" ")).alias("email"))
    return c.select("contact_id", C.normalize_email(F.col("email")).alias("email"), C.display_name(F.col("name"), F.trim("email")).alias("display_name"))


def _relative(s, d):
    from ..functions.formatting import relative_time

    return T.activities(s, d).select("activity_id", relative_time(F.col("date"), F.lit(NOW)).alias("ago"))


def _bands(s, d):
    from ..functions.formatting import human_size, relevance_band

    docs = T.table(s, d, "documents")
    return docs.select("doc_id", human_size(F.col("n_chars")).alias("size"), relevance_band(F.col("n_chars") / 5000.0).alias("band"))


QUERIES = {
    "top_deals": lambda s, d: C.top_deals(T.deals(s, d), _c(s, d), 10),
    "top_deals_total": lambda s, d: C.top_deals(T.deals(s, d), _c(s, d), 10).agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("total_value")),
    "recent_activities": lambda s, d: C.recent_activities(T.activities(s, d), _c(s, d), 20),
    "deals_by_stage": lambda s, d: C.deals_by_stage(T.deals(s, d)),
    "contacts_list": lambda s, d: C.quick_query("contacts_list", _c(s, d), T.deals(s, d), T.activities(s, d), 25),
    "hot_leads": lambda s, d: C.hot_leads(T.deals(s, d), _c(s, d)),
    "pipeline_summary": lambda s, d: C.pipeline_summary(T.deals(s, d)),
    "deals_by_stage_filter": lambda s, d: C.filter_deals(T.deals(s, d), stage="negotiation"),
    "deals_filtered": lambda s, d: C.filter_deals(T.deals(s, d), "qualified", 100000.0, dt.datetime(1995, 1, 1), dt.datetime(2030, 1, 1)),
    "deals_date_range": lambda s, d: C.date_range(T.deals(s, d), dt.datetime(1998, 1, 1), 90, 30),
    "contacts_search": lambda s, d: C.search_contacts(_c(s, d), "00_1"),
    "contacts_contains": lambda s, d: C.contacts_containing(_c(s, d), "9@EX"),
    "contacts_page": lambda s, d: C.page(_c(s, d), "name", "contact_id", offset=20, limit=25),
    "deals_page": lambda s, d: C.page(C.filter_deals(T.deals(s, d), stage="lead"), "name", "deal_id", offset=10, limit=50),
    "activities_page": lambda s, d: C.page(T.activities(s, d), F.col("date").desc(), "activity_id", offset=50, limit=100),
    "dashboard_stats": lambda s, d: C.dashboard(T.deals(s, d)),
    "stage_funnel": lambda s, d: C.stage_funnel(T.deals(s, d)),
    "sync_status": _sync_status,
    "crm_upsert_contacts": _upsert_contacts,
    "crm_upsert_deals": _upsert_deals,
    "crm_upsert_activities": _upsert_activities,
    "crm_bridge": _bridge,
    "crm_context_text": lambda s, d: C.context_text(_c(s, d), T.deals(s, d), _contact_activities(s, d), "contact"),
    "crm_question_context": lambda s, d: C.question_context(XQ._asked(s, d), _c(s, d), T.deals(s, d), _contact_activities(s, d)).select("query_id", "intent", F.size("entities").alias("entities"), "context"),
    "crm_sync_run": _sync_run,
    "crm_sync_merge": _sync_merge,
    "crm_sync_diff": _sync_diff,
    "crm_sync_runs": _sync_runs,
    "quick_query_markdown": lambda s, d: C.markdown_list(C.quick_query("top_deals", _c(s, d), T.deals(s, d), T.activities(s, d)), "Top Deals", F.col("value").desc_nulls_last(), "deal_id"),
    "account_names": _accounts,
    "crm_context_summary": lambda s, d: C.context_text(_c(s, d), T.deals(s, d), T.activities(s, d), "none"),
    "crm_cross_refs": _cross_refs,
    "relative_time": _relative,
    "relevance_band": _bands,
}

_ISO = lambda c: f"CASE WHEN strftime({c}, '%f') = '000000' THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"
_DELTA = """changed AS (SELECT deal_id, name, value + 100.0 AS value, stage, close_date, contact_id FROM deals WHERE deal_id % 10 = 0
  UNION ALL SELECT deal_id + 10000000, name, value, 'lead', close_date, -1 FROM deals WHERE deal_id % 97 = 1)"""
# A comparison column by column.
_NEXT = """later AS (SELECT deal_id, name, value + CASE WHEN deal_id % 10 = 0 THEN 100.0 ELSE 0.0 END AS value, CASE WHEN deal_id % 13 <> 1 THEN stage END AS stage, close_date, contact_id FROM deals WHERE deal_id % 17 <> 4
  UNION ALL SELECT deal_id + 10000000, name, value, stage, close_date, contact_id FROM deals WHERE deal_id % 97 = 1)"""
_CHANGE = "CASE WHEN o.deal_id IS NULL THEN 'insert' WHEN n.deal_id IS NULL THEN 'delete' WHEN (o.name, o.value, o.stage, o.close_date, o.contact_id) IS DISTINCT FROM (n.name, n.value, n.stage, n.close_date, n.contact_id) THEN 'update' ELSE 'unchanged' END"

# Blocks of lines: heading, line, order and number of lines.
_PART = lambda head, line, order, n, rows: f"(SELECT {head} || chr(10) || string_agg({line}, chr(10) ORDER BY {order}) FROM (SELECT *, count(*) OVER () AS total FROM {rows} ORDER BY {order} LIMIT {n}))"
_HEAD = lambda i: f"'{C.HEADINGS[i]}'" + (" || any_value(total) || ' total)'" if i > 2 else "")
_ACTIVITY = "'- **' || type || '** on ' || strftime(date, '%Y-%m-%d') || ': ' || substr(description, 1, 200)"
_CONTEXTS = with_sql(f""", {XQ._Q}, {XQ._ASKED}, kinds AS (SELECT activity_id, CASE type WHEN 'view' THEN 'Call' WHEN 'click' THEN 'email' WHEN 'purchase' THEN 'meeting' ELSE 'note' END AS type, date, description FROM activities ORDER BY date DESC, activity_id LIMIT 20),
touches AS (SELECT * FROM kinds WHERE lower(type) IN ('call', 'email', 'meeting')),
parts AS (SELECT {_PART(_HEAD(0), "'- **' || name || '** (Email: ' || coalesce(email, 'N/A') || ', Phone: ' || coalesce(phone, 'N/A') || ', Company: ' || coalesce(company, 'N/A') || ')'", 'name, contact_id', 50, 'contacts')} AS contacts,
  {_PART(_HEAD(1), "'- **' || name || '** (Value: ' || CASE WHEN coalesce(value, 0) <> 0 THEN '$' || format('{:,.2f}', value) ELSE 'N/A' END || ', Stage: ' || stage || ', Close: ' || coalesce(" + _ISO('close_date') + ", 'N/A') || ')'", 'name, deal_id', 50, 'deals')} AS deals,
  {_PART(_HEAD(2), _ACTIVITY, 'date DESC, activity_id', 10, 'kinds')} AS acts, {_PART(_HEAD(2), _ACTIVITY, 'date DESC, activity_id', 10, 'touches')} AS touched,
  {_PART(_HEAD(3), "'- ' || name || ' (' || coalesce(company, 'N/A') || ')'", 'name, contact_id', 5, 'contacts')} AS all_contacts, {_PART(_HEAD(4), "'- ' || name || ' — Stage: ' || stage", 'name, deal_id', 5, 'deals')} AS all_deals,
  {_PART(_HEAD(5), "'- ' || type || ' on ' || strftime(date, '%Y-%m-%d')", 'date DESC, activity_id', 5, 'kinds')} AS all_activities),
scored AS (SELECT query_id, query, q, {XQ._INTENT} FROM (SELECT query_id, query, lower(trim(query)) AS q FROM asked)),
routed AS (SELECT query_id, CASE WHEN NOT ({XQ._any('q', X.CRM_QUERY)}) THEN 'none' WHEN {XQ._BEST} = 0 THEN 'none' {' '.join(f"WHEN s_{i} = {XQ._BEST} THEN '{i}'" for i in X.CRM_INTENT)} END AS intent,
  CASE WHEN {XQ._any('q', X.CRM_QUERY)} THEN {' + '.join(f"len(list_filter(list_transform(regexp_extract_all(query, '(?i){p}', 1), lambda n: regexp_replace(trim(n), chr(92) || 's+', ' ', 'g')), lambda n: length(n) > 2))" for p, _ in X.CRM_ENTITY)} ELSE 0 END::INT AS entities FROM scored)
SELECT query_id, intent, entities, CASE intent WHEN 'contact' THEN concat_ws(chr(10), contacts, touched) WHEN 'deal' THEN deals WHEN 'cross_reference' THEN concat_ws(chr(10), deals, acts) WHEN 'activity' THEN acts
  WHEN 'quick_query' THEN concat_ws(chr(10), all_contacts, all_deals, all_activities) ELSE '' END AS context FROM routed, parts""", "contacts", "deals", "activities").replace("\n,", ",", 1)

ORACLES = {
    "crm_question_context": _CONTEXTS,
    "top_deals": with_sql("SELECT deal_id, d.name, value, stage, close_date, coalesce(c.name, 'N/A') AS contact FROM deals d LEFT JOIN contacts c USING (contact_id) ORDER BY value DESC NULLS LAST, deal_id LIMIT 10", "contacts", "deals"),
    "top_deals_total": with_sql("SELECT count(*) AS n, round(sum(coalesce(value, 0)), 2) AS total_value FROM (SELECT * FROM deals ORDER BY value DESC NULLS LAST, deal_id LIMIT 10)", "deals"),
    "recent_activities": with_sql("SELECT activity_id, type, substr(description, 1, 200) AS description, date, coalesce(c.name, 'N/A') AS contact FROM activities a LEFT JOIN contacts c USING (contact_id) ORDER BY date DESC, activity_id LIMIT 20", "contacts", "activities"),
    "deals_by_stage": with_sql("SELECT coalesce(nullif(stage, ''), 'unknown') AS stage, count(*) AS count, round(sum(coalesce(value, 0)), 2) AS value FROM deals GROUP BY 1", "deals"),
    "contacts_list": with_sql("SELECT * FROM contacts ORDER BY name, contact_id LIMIT 25", "contacts"),
    "hot_leads": with_sql("SELECT deal_id, d.name, value, stage, coalesce(c.name, 'N/A') AS contact FROM deals d LEFT JOIN contacts c USING (contact_id) WHERE stage IN ('negotiation', 'closed won', 'closed_won')", "contacts", "deals"),
    "pipeline_summary": with_sql("SELECT count(*) AS total_deals, count(*) FILTER (stage IS NULL OR stage NOT IN ('closed lost', 'closed_won', 'cancelled')) AS open_deals, round(sum(coalesce(value, 0)), 2) AS total_pipeline_value, round(sum(coalesce(value, 0)) FILTER (stage IS NULL OR stage NOT IN ('closed lost', 'closed_won', 'cancelled')), 2) AS open_pipeline_value, round(sum(coalesce(value, 0)) / count(*), 2) AS average_deal_value FROM deals", "deals"),
    "deals_by_stage_filter": with_sql("SELECT * FROM deals WHERE stage = 'negotiation'", "deals"),
    "deals_filtered": with_sql("SELECT * FROM deals WHERE stage = 'qualified' AND value >= 100000 AND close_date >= TIMESTAMP '1995-01-01' AND close_date <= TIMESTAMP '2030-01-01'", "deals"),
    "deals_date_range": with_sql("SELECT * FROM deals WHERE close_date >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY AND close_date <= TIMESTAMP '1998-01-01' + INTERVAL 30 DAY", "deals"),
    "contacts_search": with_sql("SELECT * FROM contacts WHERE name ILIKE '%00_1%' OR email ILIKE '%00_1%' OR company ILIKE '%00_1%'", "contacts"),
    "contacts_contains": with_sql("SELECT * FROM contacts WHERE contains(lower(name), '9@ex') OR contains(lower(email), '9@ex') OR contains(lower(company), '9@ex')", "contacts"),
    "contacts_page": with_sql("SELECT *, (SELECT count(*) FROM contacts) AS total FROM contacts ORDER BY name, contact_id LIMIT 25 OFFSET 20", "contacts"),
    "deals_page": with_sql("SELECT *, (SELECT count(*) FROM deals WHERE stage = 'lead') AS total FROM deals WHERE stage = 'lead' ORDER BY name, deal_id LIMIT 50 OFFSET 10", "deals"),
    "activities_page": with_sql("SELECT *, (SELECT count(*) FROM activities) AS total FROM activities ORDER BY date DESC, activity_id LIMIT 100 OFFSET 50", "activities"),
    "dashboard_stats": with_sql("SELECT round(coalesce(sum(value) FILTER (stage NOT IN ('closed_won', 'closed_lost')), 0), 2) AS active_value, round(coalesce(sum(value) FILTER (stage = 'closed_won'), 0), 2) AS won_value, round(coalesce(sum(value) FILTER (stage = 'closed_lost'), 0), 2) AS lost_value, round(coalesce(count(*) FILTER (stage = 'closed_won') * 100.0 / nullif(count(*) FILTER (stage IN ('closed_won', 'closed_lost')), 0), 0)::DOUBLE, 2) AS win_rate FROM deals", "deals"),
    "stage_funnel": with_sql("SELECT stage, count(*) AS count, list_position(['lead', 'qualified', 'proposal', 'negotiation', 'closed_won', 'closed_lost'], stage)::INT AS position FROM deals GROUP BY stage", "deals"),
    "sync_status": with_sql("SELECT (SELECT count(*) FROM contacts) AS contacts, (SELECT count(*) FROM deals) AS deals, (SELECT count(*) FROM activities) AS activities, activity_id AS run_id, CASE WHEN activity_id % 3 <> 0 THEN date END AS completed_at FROM activities WHERE type = 'purchase' ORDER BY completed_at DESC NULLS LAST, run_id LIMIT 1", "contacts", "deals", "activities"),
    "crm_upsert_contacts": with_sql("SELECT contact_id, name, email, CASE WHEN contact_id % 7 = 0 THEN '+1-555-0100' ELSE phone END AS phone, company FROM contacts", "contacts"),
    "crm_upsert_deals": with_sql(f", {_DELTA}, resolved AS (SELECT d.deal_id, d.value, d.stage, coalesce(c.contact_id, o.contact_id) AS contact_id FROM changed d LEFT JOIN contacts c ON c.contact_id = d.contact_id LEFT JOIN deals o ON o.deal_id = d.deal_id), merged AS (SELECT deal_id, value, stage, contact_id FROM resolved UNION ALL SELECT deal_id, value, stage, contact_id FROM deals WHERE deal_id NOT IN (SELECT deal_id FROM resolved)) SELECT stage, count(*) AS n, count(contact_id) AS linked, round(sum(value), 2) AS value FROM merged GROUP BY stage".lstrip(), "contacts", "deals").replace("\n,", ","),
    "crm_upsert_activities": with_sql("SELECT type, count(*) AS n, count(contact_id) AS linked, count(*) FILTER (description = 'updated') AS updated FROM (SELECT type, CASE WHEN activity_id % 5 = 0 THEN 'updated' ELSE description END AS description, CASE WHEN activity_id % 5 = 0 THEN (SELECT min(k.contact_id) FROM contacts k WHERE k.contact_id = a.contact_id) ELSE contact_id END AS contact_id FROM activities a UNION ALL SELECT type, description, NULL FROM activities WHERE activity_id % 50 = 3) GROUP BY type", "contacts", "activities"),
    "crm_bridge": with_sql(f"""SELECT 'crm-contact' AS source, contact_id AS external_id, 'Contact: ' || name AS title, 'CRM Contact: ' || name || chr(10) || 'Email: ' || coalesce(email, 'N/A') || chr(10) || 'Phone: ' || coalesce(phone, 'N/A') || chr(10) || 'Company: ' || coalesce(company, 'N/A') AS text FROM contacts WHERE contact_id % 2 <> 0
UNION ALL SELECT 'crm-deal', deal_id, 'Deal: ' || name, CASE WHEN coalesce(value, 0) <> 0 THEN 'CRM Deal: ' || name || chr(10) || 'Value: $' || format('{{:,.2f}}', value) ELSE 'Value: N/A' || chr(10) || 'Stage: ' || stage || chr(10) || 'Close Date: ' || coalesce({_ISO('close_date')}, 'N/A') END FROM deals
UNION ALL SELECT 'crm-activity', activity_id, 'Activity: ' || type || ' — ' || strftime(date, '%Y-%m-%d'), 'CRM Activity: ' || type || chr(10) || 'Date: ' || {_ISO('date')} || chr(10) || 'Description: ' || description FROM activities""", "contacts", "deals", "activities"),
    "crm_context_text": with_sql("""SELECT 1 AS section, contact_id AS position, '- **' || name || '** (Email: ' || coalesce(email, 'N/A') || ', Phone: ' || coalesce(phone, 'N/A') || ', Company: ' || coalesce(company, 'N/A') || ')' AS line FROM contacts
UNION ALL SELECT * FROM (SELECT 3, activity_id, '- **' || type || '** on ' || strftime(date, '%Y-%m-%d') || ': ' || substr(description, 1, 200) FROM (SELECT activity_id, CASE type WHEN 'view' THEN 'Call' WHEN 'click' THEN 'email' WHEN 'purchase' THEN 'meeting' ELSE 'note' END AS type, date, description FROM activities ORDER BY date DESC, activity_id LIMIT 20) WHERE lower(type) IN ('call', 'email', 'meeting') ORDER BY date DESC, activity_id LIMIT 10)""", "contacts", "activities"),
    "crm_sync_run": with_sql("SELECT * FROM (VALUES (1, 'success', 0, 0, 1, 2, 3, NULL), (2, 'error', 0, 0, NULL, NULL, NULL, 'timeout'), (3, 'success', 0, 300, (SELECT count(*) FROM contacts WHERE contact_id % 7 = 0), (SELECT count(*) FILTER (deal_id % 10 = 0) + count(*) FILTER (deal_id % 97 = 1) FROM deals), (SELECT count(*) FROM activities WHERE activity_id % 5 = 0), NULL), (4, 'error', 300, 300, NULL, NULL, NULL, 'no route')) AS t(run_id, status, started, completed, contacts_synced, deals_synced, activities_synced, error_message)", "contacts", "deals", "activities").replace("SELECT * FROM (VALUES", "SELECT run_id::BIGINT AS run_id, status, started::BIGINT + 1705276800 AS started, completed::BIGINT + 1705276800 AS completed, contacts_synced::BIGINT AS contacts_synced, deals_synced::BIGINT AS deals_synced, activities_synced::BIGINT AS activities_synced, error_message FROM (VALUES"),
    "crm_sync_diff": with_sql(f", {_NEXT} SELECT deal_id, CASE WHEN n.deal_id IS NULL THEN o.stage ELSE n.stage END AS stage, round(CASE WHEN n.deal_id IS NULL THEN o.value ELSE n.value END, 2) AS value, {_CHANGE} AS change FROM deals o FULL JOIN later n USING (deal_id)", "deals").replace("\n,", ","),
    "crm_sync_runs": with_sql(f", {_NEXT}, changes AS (SELECT {_CHANGE} AS change FROM deals o FULL JOIN later n USING (deal_id)), counts AS (SELECT {', '.join(f'count(*) FILTER (change = {c!r}) AS {c}' for c in H.CHANGES)} FROM changes) SELECT 0::BIGINT AS batch, count(*) AS insert, 0::BIGINT AS update, 0::BIGINT AS delete, 0::BIGINT AS unchanged FROM deals UNION ALL SELECT 1, insert, update, delete, unchanged FROM counts UNION ALL SELECT 2, delete, update, insert, unchanged FROM counts", "deals").replace("\n,", ","),
    "quick_query_markdown": with_sql("SELECT chr(10) || '**Top Deals:**' || chr(10) || string_agg('- deal_id: ' || deal_id || ', name: ' || name || ', value: ' || value || ', stage: ' || stage, chr(10) ORDER BY value DESC, deal_id) AS text FROM (SELECT * FROM deals ORDER BY value DESC NULLS LAST, deal_id LIMIT 5)", "deals"),
    "account_names": with_sql("SELECT contact_id, email, CASE WHEN contact_id % 3 = 0 THEN name ELSE upper(string_split(email, '@')[1]) END AS display_name FROM contacts", "contacts"),
    "crm_context_summary": with_sql("""SELECT * FROM (SELECT 1 AS section, contact_id AS position, '- ' || name || ' (' || coalesce(company, 'N/A') || ')' AS line FROM contacts ORDER BY name, contact_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 2, deal_id, '- ' || name || ' — Stage: ' || stage FROM deals ORDER BY name, deal_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 3, activity_id, '- ' || type || ' on ' || strftime(date, '%Y-%m-%d') FROM activities ORDER BY date DESC, activity_id LIMIT 5)""", "contacts", "deals", "activities"),
    "crm_cross_refs": with_sql(""", pairs AS (SELECT name, company AS db_match FROM contacts UNION ALL SELECT p_name, string_split(p_name, ' ')[-1] FROM part),
names AS (SELECT lower(key) AS key, min({'rank': rank, 'entity': name}) AS m FROM (SELECT name, name AS key, 0 AS rank FROM pairs UNION ALL SELECT name, db_match, 1 FROM pairs) WHERE key <> '' GROUP BY lower(key))
SELECT m.entity AS entity, chunk_id, document_id, substr(content, 1, 200) AS content_snippet, CASE WHEN m.rank = 0 THEN 'direct' ELSE 'company' END AS match_type FROM lines JOIN names ON contains(lower(content), key)""".lstrip(), "lines", "contacts").replace("\n,", ","),
    "relative_time": with_sql("SELECT activity_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm ago' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h ago' ELSE (s // 86400)::VARCHAR || 'd ago' END AS ago FROM (SELECT activity_id, floor(epoch(TIMESTAMP '2024-01-15' ) - epoch(date))::BIGINT AS s FROM activities)", "activities"),
    "relevance_band": "SELECT doc_id, CASE WHEN n_chars < 1048576 THEN printf('%.1f KB', round(n_chars / 1024.0, 1)) ELSE printf('%.1f MB', round(n_chars / 1048576.0, 1)) END AS size, CASE WHEN n_chars / 5000.0 >= 0.8 THEN 'high' WHEN n_chars / 5000.0 >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM documents",
}
ORACLES["crm_sync_merge"] = ORACLES["crm_upsert_deals"]
