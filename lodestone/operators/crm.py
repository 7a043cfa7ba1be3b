"""Contacts, deals and activities: presets, pages, filters, dashboards, text templates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import written
from . import matching

# Stages, in pipeline order, and what counts as late or no longer open.
STAGES = ("lead", "qualified", "proposal", "negotiation", "closed_won", "closed_lost")
LATE_STAGES = ("negotiation", "closed won", "closed_won")
NOT_OPEN = ("closed lost", "closed_won", "cancelled")
CONTACT_TYPES = ("call", "email", "meeting")
PRESETS = ("top_deals", "recent_activities", "deals_by_stage", "contacts_list", "hot_leads", "pipeline_summary")


def with_contact(rows: DataFrame, contacts: DataFrame) -> DataFrame:
    """``rows`` with ``contact``, the name of the contact or ``N/A``."""
    names = contacts.select("contact_id", F.col("name").alias("contact"))
    return rows.join(names, "contact_id", "left").withColumn("contact", F.coalesce("contact", F.lit("N/A")))


def top_deals(deals: DataFrame, contacts: DataFrame, limit: int = 10) -> DataFrame:
    """The deals of highest value, nulls last: the top rows are taken before the join, which then is tiny."""
    best = deals.orderBy(F.col("value").desc_nulls_last(), "deal_id").limit(limit)
    return with_contact(best, contacts).select("deal_id", "name", "value", "stage", "close_date", "contact")


def recent_activities(activities: DataFrame, contacts: DataFrame, limit: int = 10) -> DataFrame:
    last = activities.orderBy(F.col("date").desc(), "activity_id").limit(limit)
    return with_contact(last, contacts).select("activity_id", "type", F.substring("description", 1, 200).alias("description"), "date", "contact")


def deals_by_stage(deals: DataFrame) -> DataFrame:
    stage = F.when(F.coalesce("stage", F.lit("")) == "", "unknown").otherwise(F.col("stage"))
    return deals.groupBy(stage.alias("stage")).agg(F.count("*").alias("count"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("value"))


def hot_leads(deals: DataFrame, contacts: DataFrame) -> DataFrame:
    return with_contact(deals.where(F.col("stage").isin(*LATE_STAGES)), contacts).select("deal_id", "name", "value", "stage", "contact")


def pipeline_summary(deals: DataFrame) -> DataFrame:
    """One pass; the average divides by all deals, those without a value too."""
    value = F.coalesce("value", F.lit(0.0))
    still_open = F.coalesce(~F.col("stage").isin(*NOT_OPEN), F.lit(True))
    return deals.agg(
        F.count("*").alias("total_deals"),
        F.count_if(still_open).alias("open_deals"),
        F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2).alias("total_pipeline_value"),
        F.round(F.coalesce(F.sum(F.when(still_open, value)), F.lit(0.0)), 2).alias("open_pipeline_value"),
        F.round(F.coalesce(F.try_divide(F.sum(value), F.count("*")), F.lit(0.0)), 2).alias("average_deal_value"),
    )


def filter_deals(deals: DataFrame, stage: str | None = None, min_value: float | None = None, close_from=None, close_to=None) -> DataFrame:
    """Only the filters that are given; a null never passes one."""
    if stage is not None:
        deals = deals.where(F.col("stage") == stage)
    if min_value is not None:
        deals = deals.where(F.col("value") >= min_value)
    if close_from is not None:
        deals = deals.where(F.col("close_date") >= F.lit(close_from))
    if close_to is not None:
        deals = deals.where(F.col("close_date") <= F.lit(close_to))
    return deals


def search_contacts(contacts: DataFrame, text: str) -> DataFrame:
    """Case-insensitive pattern in name, email or company; ``%`` and ``_`` in ``text`` are wildcards."""
    p = f"%{text}%"
    return contacts.where(F.col("name").ilike(p) | F.col("email").ilike(p) | F.col("company").ilike(p))


def contacts_containing(contacts: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring in name, email or company; no wildcards."""
    q = text.lower()
    has = [F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False)) for c in ("name", "email", "company")]
    return contacts.where(has[0] | has[1] | has[2])


def page(rows: DataFrame, *order, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of an order that must be total, with ``total``, the number of all rows."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset at least 0")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # the total is one row


def dashboard(deals: DataFrame) -> DataFrame:
    won, lost = F.col("stage") == "closed_won", F.col("stage") == "closed_lost"
    value = F.coalesce("value", F.lit(0.0))
    n_won, n_lost = F.count_if(won), F.count_if(lost)
    return deals.agg(
        F.round(F.coalesce(F.sum(F.when(~won & ~lost, value)), F.lit(0.0)), 2).alias("active_value"),
        F.round(F.coalesce(F.sum(F.when(won, value)), F.lit(0.0)), 2).alias("won_value"),
        F.round(F.coalesce(F.sum(F.when(lost, value)), F.lit(0.0)), 2).alias("lost_value"),
        F.round(F.coalesce(F.try_divide(n_won * 100.0, n_won + n_lost), F.lit(0.0)), 2).alias("win_rate"),
    )


def stage_funnel(deals: DataFrame) -> DataFrame:
    """Deals of each stage in pipeline order; stages without deals don't appear."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return deals.where(F.col("stage").isin(*STAGES)).groupBy("stage").agg(F.count("*").alias("count")).withColumn("position", order.cast("int"))


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def iso(ts: Column) -> Column:
    """ISO 8601; fractions of a second only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))


def bridge_documents(contacts: DataFrame, deals: DataFrame, activities: DataFrame, fixed: bool = False) -> DataFrame:
    """Every row as a small document ``source, external_id, title, text``.

    A deal with a value has only its name and value in the text, one without only the rest; ``fixed`` gives all lines.
    """
    na = F.lit("N/A")
    c = contacts.select(
        F.lit("crm-contact").alias("source"), F.col("contact_id").alias("external_id"), F.concat(F.lit("Contact: "), "name").alias("title"),
        F.concat(F.lit("CRM Contact: "), "name", F.lit("\nEmail: "), F.coalesce("email", na), F.lit("\nPhone: "), F.coalesce("phone", na), F.lit("\nCompany: "), F.coalesce("company", na)).alias("text"),
    )
    name = F.concat(F.lit("CRM Deal: "), F.col("name"), F.lit("\n"))
    worth = F.concat(F.lit("Value: "), money(F.col("value")))
    rest = F.concat(F.lit("\nStage: "), F.col("stage"), F.lit("\nClose Date: "), F.coalesce(iso(F.col("close_date")), na))
    has = F.coalesce(F.col("value"), F.lit(0.0)) != 0
    text = F.when(has, F.concat(name, worth, *([rest] if fixed else []))).otherwise(F.concat(*([name] if fixed else []), F.lit("Value: N/A"), rest))
    d = deals.select(F.lit("crm-deal").alias("source"), F.col("deal_id").alias("external_id"), F.concat(F.lit("Deal: "), "name").alias("title"), text.alias("text"))
    a = activities.select(
        F.lit("crm-activity").alias("source"), F.col("activity_id").alias("external_id"),
        F.concat(F.lit("Activity: "), "type", F.lit(" — "), F.date_format("date", "yyyy-MM-dd")).alias("title"),
        F.concat(F.lit("CRM Activity: "), "type", F.lit("\nDate: "), iso(F.col("date")), F.lit("\nDescription: "), "description").alias("text"),
    )
    return c.unionByName(d).unionByName(a)


def new_documents(bridge: DataFrame, existing: DataFrame) -> DataFrame:
    """Bridge documents whose title is no file name of ``existing`` yet."""
    return bridge.join(existing.select(F.col("filename").alias("title")), "title", "left_anti")


def context_text(contacts: DataFrame, deals: DataFrame, activities: DataFrame, intent: str, recent: int = 20) -> DataFrame:
    """The lines of the context block for an intent, ``section, position, line``. Of the activities only the ``recent``
    newest count, for contacts only those of them that are calls, e-mails or meetings."""
    activities = activities.orderBy(F.col("date").desc(), "activity_id").limit(recent)
    if intent == "contact":
        activities = activities.where(F.lower("type").isin(*CONTACT_TYPES))
    na = F.lit("N/A")
    out = None

    def add(section: int, rows: DataFrame, line: Column, order: list, limit: int | None) -> None:
        nonlocal out
        rows = rows.orderBy(*order).limit(limit) if limit else rows
        one = rows.select(F.lit(section).alias("section"), F.col(order[-1] if isinstance(order[-1], str) else "id").alias("position"), line.alias("line"))
        out = one if out is None else out.unionByName(one)

    if intent == "contact":
        add(1, contacts, F.concat(F.lit("- **"), "name", F.lit("** (Email: "), F.coalesce("email", na), F.lit(", Phone: "), F.coalesce("phone", na), F.lit(", Company: "), F.coalesce("company", na), F.lit(")")), ["name", "contact_id"], None)
    if intent in ("deal", "cross_reference"):
        worth = F.when(F.coalesce("value", F.lit(0.0)) != 0, money(F.col("value"))).otherwise(na)
        add(2, deals, F.concat(F.lit("- **"), "name", F.lit("** (Value: "), worth, F.lit(", Stage: "), "stage", F.lit(", Close: "), F.coalesce(iso(F.col("close_date")), na), F.lit(")")), ["name", "deal_id"], None)
    if intent in ("activity", "contact", "cross_reference"):
        add(3, activities, F.concat(F.lit("- **"), "type", F.lit("** on "), F.date_format("date", "yyyy-MM-dd"), F.lit(": "), F.substring("description", 1, 200)), [F.col("date").desc(), "activity_id"], 10)
    if out is None:
        add(1, contacts, F.concat(F.lit("- "), "name", F.lit(" ("), F.coalesce("company", na), F.lit(")")), ["name", "contact_id"], 5)
        add(2, deals, F.concat(F.lit("- "), "name", F.lit(" — Stage: "), "stage"), ["name", "deal_id"], 5)
        add(3, activities, F.concat(F.lit("- "), "type", F.lit(" on "), F.date_format("date", "yyyy-MM-dd")), [F.col("date").desc(), "activity_id"], 5)
    return out


# Headings of the context block; the last three stand over summaries, before a number.
HEADINGS = ("### CRM Contacts", "### CRM Deals / Opportunities", "### CRM Activities", "### CRM Contacts (all — ", "### CRM Deals (all — ", "### CRM Activities (recent — ")
RECENT, LISTED, SUMMARY = 20, 10, 5


def context_blocks(contacts: DataFrame, deals: DataFrame, activities: DataFrame, most: int = 50) -> DataFrame:
    """``intent, context``: the block of each of the five intents, five rows whatever the tables hold.

    Contacts (by name) and deals (by name) take ``most`` lines, the room of a prompt; activities the 10 newest of the 20
    newest, for contacts only calls, e-mails and meetings. Where an intent's own sections are empty, what is left is
    summed up in 5 lines each. Each table is read for its first rows and its count; null names and dates become N/A.
    """
    na = F.lit("N/A")
    text = lambda c: F.coalesce(c, na)
    day = text(F.date_format("date", "yyyy-MM-dd"))
    worth = F.when(F.coalesce("value", F.lit(0.0)) != 0, money(F.col("value"))).otherwise(na)
    newest = [F.col("date").desc_nulls_last(), F.col("activity_id")]
    last = activities.orderBy(*newest).limit(RECENT)
    for_contacts = last.where(F.lower("type").isin(*CONTACT_TYPES))
    by = lambda key: [F.col("name").asc_nulls_last(), F.col(key)]
    contact = F.concat(F.lit("- **"), text(F.col("name")), F.lit("** (Email: "), text(F.col("email")), F.lit(", Phone: "), text(F.col("phone")), F.lit(", Company: "), text(F.col("company")), F.lit(")"))
    deal = F.concat(F.lit("- **"), text(F.col("name")), F.lit("** (Value: "), worth, F.lit(", Stage: "), text(F.col("stage")), F.lit(", Close: "), text(iso(F.col("close_date"))), F.lit(")"))
    activity = F.concat(F.lit("- **"), text(F.col("type")), F.lit("** on "), day, F.lit(": "), F.coalesce(F.substring("description", 1, 200), F.lit("")))
    parts = None

    def add(name: str, rows: DataFrame, order: list, line: Column, heading: str, lines: int, counted: bool = False) -> None:
        nonlocal parts
        first = rows.orderBy(*order).limit(lines).select(F.row_number().over(Window.orderBy(*order)).alias("place"), line.alias("line"))
        body = F.array_join(F.array_sort(F.collect_list(F.struct("place", "line")))["line"], "\n")
        one = first.agg(F.lit(name).alias("part"), body.alias("body"), F.lit(0).cast("long").alias("total"))
        if counted:
            one = one.unionByName(rows.agg(F.lit(name).alias("part"), F.lit("").alias("body"), F.count("*").alias("total"))).groupBy("part").agg(F.max("body").alias("body"), F.max("total").alias("total"))
        head = F.concat(F.lit(heading), F.col("total").cast("string"), F.lit(" total)")) if counted else F.lit(heading)
        one = one.where("body <> ''").select("part", F.concat(head, F.lit("\n"), "body").alias("text"))
        parts = one if parts is None else parts.unionByName(one)

    add("contacts", contacts, by("contact_id"), contact, HEADINGS[0], most)
    add("deals", deals, by("deal_id"), deal, HEADINGS[1], most)
    add("activities", last, newest, activity, HEADINGS[2], LISTED)
    add("touches", for_contacts, newest, activity, HEADINGS[2], LISTED)
    add("all_contacts", contacts, by("contact_id"), F.concat(F.lit("- "), text(F.col("name")), F.lit(" ("), text(F.col("company")), F.lit(")")), HEADINGS[3], SUMMARY, True)
    add("all_deals", deals, by("deal_id"), F.concat(F.lit("- "), text(F.col("name")), F.lit(" — Stage: "), text(F.col("stage"))), HEADINGS[4], SUMMARY, True)
    add("all_activities", last, newest, F.concat(F.lit("- "), text(F.col("type")), F.lit(" on "), day), HEADINGS[5], SUMMARY, True)
    names = ("contacts", "deals", "activities", "touches", "all_contacts", "all_deals", "all_activities")
    wide = parts.groupBy().agg(*(F.max(F.when(F.col("part") == n, F.col("text"))).alias(n) for n in names))
    block = lambda own, rest: F.coalesce(F.nullif(F.concat_ws("\n", *own), F.lit("")), F.concat_ws("\n", *rest))
    made = {
        "contact": block(["contacts", "touches"], [F.lit("")]),
        "deal": block(["deals"], ["all_activities"]),
        "cross_reference": block(["deals", "activities"], ["all_contacts"]),
        "activity": block(["activities"], [F.lit("")]),
        "quick_query": F.concat_ws("\n", "all_contacts", "all_deals", "all_activities"),
    }
    return wide.select(F.explode(F.array(*(F.struct(F.lit(i).alias("intent"), c.alias("context")) for i, c in made.items()))).alias("b")).select("b.*")


def question_context(questions: DataFrame, contacts: DataFrame, deals: DataFrame, activities: DataFrame, most: int = 50) -> DataFrame:
    """Every question (query_id, query) with ``intent`` (``none`` where it isn't about the CRM), the ``entities`` it names
    and its ``context`` (empty for ``none``). Blocks are made once an intent, five rows that every task gets."""
    about = F.coalesce(X.is_crm_query(F.col("query")), F.lit(False))
    none = F.array().cast("array<struct<name:string,type:string,confidence:double>>")
    q = questions.select("query_id", F.when(about, X.crm_intent(F.col("query"))).otherwise("none").alias("intent"), F.when(about, F.coalesce(X.crm_entities(F.col("query")), none)).otherwise(none).alias("entities"))
    blocks = F.broadcast(context_blocks(contacts, deals, activities, most))
    return q.join(blocks, "intent", "left").select("query_id", "intent", "entities", F.coalesce("context", F.lit("")).alias("context"))


def cross_references(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities (``name`` and, where a database name matched, ``db_match``) mentioned in chunks, each pair of lower-cased
    name and chunk once: of names alike the direct one, then the first. Chunks are walked by automata of the names."""
    n = names.select(F.col("name").alias("entity"), F.lower("name").alias("direct"), F.lower("db_match").alias("company"))
    each = n.select("entity", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("direct").alias("key")), F.struct(F.lit(1).alias("rank"), F.col("company").alias("key")))).alias("k")).select("entity", "k.*").where("key <> ''")
    one = written(each.groupBy("key").agg(F.min(F.struct("rank", "entity")).alias("m")), "names")
    texts = chunks.select("chunk_id", "document_id", F.substring("content", 1, 200).alias("content_snippet"), F.lower("content").alias("_text"))
    few = one.count() <= matching.SHARD_NAMES
    hit = matching.contained(texts, "_text", one.select("key")).join(F.broadcast(one) if few else one, "key")
    return hit.select(F.col("m.entity").alias("entity"), "chunk_id", "document_id", "content_snippet", F.when(F.col("m.rank") == 0, "direct").otherwise("company").alias("match_type"))


def quick_query(preset: str, contacts: DataFrame, deals: DataFrame, activities: DataFrame, limit: int = 10) -> DataFrame:
    """One of ``PRESETS`` as a table."""
    if preset not in PRESETS:
        raise ValueError(f"no preset {preset!r}; there are {', '.join(PRESETS)}")
    return {
        "top_deals": lambda: top_deals(deals, contacts, limit),
        "recent_activities": lambda: recent_activities(activities, contacts, limit),
        "deals_by_stage": lambda: deals_by_stage(deals),
        "contacts_list": lambda: contacts.orderBy("name", "contact_id").limit(limit),
        "hot_leads": lambda: hot_leads(deals, contacts),
        "pipeline_summary": lambda: pipeline_summary(deals),
    }[preset]()


def markdown_list(rows: DataFrame, title: str, *order, items: int = 5, fields: int = 4) -> DataFrame:
    """The ``items`` first rows as one Markdown ``text``: a bold title, then a line a row with its first ``fields`` values
    that aren't null. Only those rows come together; no row gives the title alone."""
    parts = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), iso(F.col(c)) if t.startswith("timestamp") else F.col(c).cast("string"))) for c, t in rows.dtypes)))
    line = F.concat(F.lit("- "), F.array_join(F.slice(parts, 1, fields), ", "))
    first = rows.orderBy(*order).limit(items).select(F.row_number().over(Window.orderBy(*order)).alias("place"), line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    return first.agg(F.array_join(F.concat(F.array(F.lit(f"\n**{title}:**")), lines["line"]), "\n").alias("text"))


def normalize_email(email: Column) -> Column:
    return F.trim(F.lower(email))


def display_name(name: Column, email: Column) -> Column:
    """The given name, or the part of the address before the @ where it is null or empty."""
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.split(email, "@")[0])


def date_range(deals: DataFrame, now: dt.datetime, back: int, ahead: int) -> DataFrame:
    return filter_deals(deals, close_from=now - dt.timedelta(days=back), close_to=now + dt.timedelta(days=ahead))
