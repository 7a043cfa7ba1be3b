"""CRM context of questions: blocks by intent, empty and odd tables, the question pipeline with it."""

import datetime as dt

from lodestone.operators import crm as C

CONTACTS = "contact_id long, name string, email string, phone string, company string, context string"
DEALS = "deal_id long, name string, value double, stage string, close_date timestamp, contact_id long"
ACTIVITIES = "activity_id long, type string, description string, date timestamp, contact_id long"
DAY = dt.datetime(2024, 3, 5)


def tables(spark, contacts=(), deals=(), activities=()):
    return spark.createDataFrame(list(contacts), CONTACTS), spark.createDataFrame(list(deals), DEALS), spark.createDataFrame(list(activities), ACTIVITIES)


def blocks(spark, *rows, most=50):
    return {r.intent: r.context for r in C.context_blocks(*tables(spark, *rows), most).collect()}


def test_sections_of_each_intent(spark):
    contacts = [(1, "Ada", "a@x.example", None, "Ink", "clash"), (2, None, None, None, None, None)]
    deals = [(1, "Roof", 1234.5, "lead", DAY, 1), (2, "Attic", 0.0, None, None, None)]
    activities = [(i, "Call" if i % 2 else "note", "d" * 300 if i == 1 else None, DAY - dt.timedelta(days=i), 1) for i in range(25)] + [(99, None, None, None, None)]
    got = blocks(spark, contacts, deals, activities)
    assert got["contact"].startswith("### CRM Contacts\n- **Ada** (Email: a@x.example, Phone: N/A, Company: Ink)\n- **N/A** (Email: N/A, Phone: N/A, Company: N/A)\n### CRM Activities\n- **Call** on 2024-03-04: " + "d" * 200 + "\n- **Call** on 2024-03-02: \n")
    assert got["deal"] == "### CRM Deals / Opportunities\n- **Attic** (Value: N/A, Stage: N/A, Close: N/A)\n- **Roof** (Value: $1,234.50, Stage: lead, Close: 2024-03-05T00:00:00)"
    assert got["activity"].count("\n") == 10 and got["cross_reference"] == got["deal"] + "\n" + got["activity"]
    # Calls among the 20 newest only: the numbers 1, 3, ... 19.
    assert got["contact"].count("**Call**") == 10
    assert "(all — 2 total)\n- Ada (Ink)" in got["quick_query"] and got["quick_query"].endswith("(recent — 20 total)\n" + "\n".join(f"- {'Call' if i % 2 else 'note'} on {(DAY - dt.timedelta(days=i)):%Y-%m-%d}" for i in range(5)))
    assert blocks(spark, contacts, deals, activities, most=1)["deal"].count("\n") == 1


def test_what_is_left_where_sections_are_empty(spark):
    assert set(blocks(spark).values()) == {""} and len(blocks(spark)) == 5
    calls = blocks(spark, [], [], [(1, "call", "x", DAY, 1)])
    assert calls["deal"] == "### CRM Activities (recent — 1 total)\n- call on 2024-03-05" and calls["contact"] == calls["activity"] == "### CRM Activities\n- **call** on 2024-03-05: x"
    people = blocks(spark, [(1, "Ada", None, None, None, None)])
    assert people["cross_reference"] == "### CRM Contacts (all — 1 total)\n- Ada (N/A)" and people["deal"] == people["activity"] == ""


def test_questions_get_the_block_of_their_intent(spark):
    asked = [(1, "list deals in the pipeline"), (2, "explain tides"), (3, None), (4, "who is contact Ada Lovelace"), (4, "who is contact Ada Lovelace")]
    t = tables(spark, [(1, "Ada", None, None, None, None)], [(1, "Roof", 5.0, "lead", DAY, 1)])
    got = sorted((r.query_id, r.intent, len(r.entities), r.context) for r in C.question_context(spark.createDataFrame(asked, "query_id long, query string"), *t).collect())
    by = blocks(spark, [(1, "Ada", None, None, None, None)], [(1, "Roof", 5.0, "lead", DAY, 1)])
    assert got == [(1, "deal", 0, by["deal"]), (2, "none", 0, ""), (3, "none", 0, ""), (4, "contact", 1, by["contact"]), (4, "contact", 1, by["contact"])]


def test_pipeline_shows_the_model_the_context(spark):
    from lodestone.plans.composites import answer_pipeline

    def model():
        return lambda prompts: ['{"answer_text": "%s", "citations": [{"chunk_id": "1", "document_id": "1", "content_snippet": ""}], "confidence_score": 0.9}' % ("The harbour of Bremen deals with Roof." if "**Roof**" in p else "The harbour of Bremen deals with nothing.") for p in prompts]

    chunks = spark.createDataFrame([(1, "The harbour of Bremen deals with ships, roof and nothing."), (2, "Trains leave late."), (3, "Ferries leave early.")], "id long, content string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, "define deals of harbour bremen", [1.0, 0.0]), (2, "define harbour of bremen", [1.0, 0.0])], "query_id long, query string, embedding array<double>")
    crm = tables(spark, [], [(1, "Roof", 5.0, "lead", DAY, 1)])
    got = {r.query_id: r.response for r in answer_pipeline(queries, chunks, vectors, 2, model, crm).collect()}
    assert "deals with Roof" in got[1] and "deals with nothing" in got[2]
