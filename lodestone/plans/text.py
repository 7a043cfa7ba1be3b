"""Queries of text functions and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formatting as FM
from ..functions import text as X
from ..operators import robots as RB
from ..sources import tables as T

#: Questions for classification, one of each kind and some ties.
QUESTIONS = (
    "hello there", "thanks a lot", "?", "what is up", "!!!!!!", "asdf jkl", "ok", "what is a contract", "how to close a deal", "define revenue",
    "why are sales down", "compare both offers", "explain the pipeline", "what happened on 2024-01-15", "steps to summarize", "tell me about Berlin",
    "show me top deals", "recent activities this week", "who is the contact person", "email sent last week", "list all stages", "documents related to Acme",
    "contact John Smith of sales", "company Acme Corp and deal Big Rollout", "call +1-555-123-4567 now", "email jane.doe@example.com please", "meeting today", "count hot leads",
)


def _questions(s):
    return s.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, query string")


def _asked(s, d):
    """The questions above, and every benchmark text as one."""
    return _questions(s).unionByName(T.table(s, d, "benchmark").select((F.col("item_id") + 1000).cast("int").alias("query_id"), F.col("text").alias("query")))


def _docs(s, d):
    return T.table(s, d, "documents")


def _names(s, d):
    """File names with different endings from the documents' sources."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".docx", ".html", ".Htm", ".txt", ".md", ".exe", "")]), (F.col("doc_id") % 8 + 1).cast("int"))
    return _docs(s, d).select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("filename"), "n_chars")


def _upload(s, d):
    declared = F.when(F.col("doc_id") % 3 == 0, "text/plain").when(F.col("doc_id") % 3 == 1, "image/png")
    size = F.when(F.col("doc_id") % 11 == 0, 0).when(F.col("doc_id") % 13 == 0, 60_000_000).otherwise(F.col("n_chars"))
    return _names(s, d).select("doc_id", X.upload_rejection(F.col("filename"), declared, size).alias("status"))


def _markdown(s, d):
    lines = F.concat(F.lit("# "), F.regexp_replace("text", "\n", "\n- "), F.lit("\n```code\nblock```\n**bold** and *it* [link](http://x) ~~gone~~ `x`\n1. one\n---\n\n\n\nend"))
    return _docs(s, d).select("doc_id", F.md5(X.strip_markdown(lines)).alias("digest"))


def _pdf(s, d):
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("D:"), stamp, F.lit("+00'00'"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("D:"), stamp)).when(F.col("event_id") % 4 == 2, F.concat(F.lit("D:"), F.substring(stamp, 1, 8))).otherwise(F.concat(F.lit(" "), stamp))
    return T.table(s, d, "events").select("event_id", X.pdf_date(raw).alias("iso"))


def _route(s, d):
    q = _questions(s)
    q = q.unionByName(T.table(s, d, "benchmark").select((F.col("item_id") + 1000).cast("int").alias("query_id"), F.col("text").alias("query")))
    return q.select("query_id", X.query_class(F.col("query")).alias("query_type"))


def _entities(s, d):
    e = X.each_entity(_docs(s, d).select("doc_id", "text"), "text").select("doc_id", "e.*")
    e = e.withColumn("entity_id", X.entity_id(F.col("name"), F.col("type")))
    # The first spelling of an entity in a document is the one that stays.
    first = e.groupBy("doc_id", "entity_id").agg(F.min_by(F.struct("name", "type", "confidence"), "place").alias("v"))
    return first.select("doc_id", "entity_id", "v.*")


def _llm_json(s, d):
    b = T.table(s, d, "benchmark")
    conf = (F.col("item_id") % 10) / 10.0
    body = F.concat(F.lit('{"answer_text": "'), F.regexp_replace("text", r"[^a-zA-Z ]", ""), F.lit('", "confidence_score": '), conf.cast("string"), F.lit("}"))
    raw = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("Here it is "), body, F.lit(" bye"))).otherwise("no json here")
    parsed = F.from_json(X.model_json(raw), "answer_text string, confidence_score double")
    return b.select("item_id", parsed["answer_text"].alias("answer_text"), parsed["confidence_score"].alias("confidence"))


def _robots(s, d):
    """A file for each origin of the pages, by the length of its name: empty, for all, for all and for us, none."""
    sites = T.table(s, d, "pages").groupBy(RB.origin(F.col("url")).alias("origin")).agg(F.min(RB.path(F.col("url"))).alias("first"))
    ours = F.concat(F.lit(f"User-agent: *\r\nDisallow: /\r\n\r\n# ours\r\nuser-agent: {RB.AGENT.title()}\r\ndisallow: /en/6\r\nDisallow:   "), F.substring("first", 1, 5))
    kind = F.length("origin") % 4
    content = F.when(kind == 0, "").when(kind == 1, "User-agent: *\nDisallow: /en/1\nDisallow: /en\nDisallow:\nUser-agent: other\nDisallow: /\n").when(kind == 2, ours)
    return sites.select("origin", content.alias("content"))


QUERIES = {
    "robots_judged": lambda s, d: RB.judge(T.table(s, d, "pages"), _robots(s, d)).select("page_id", "robots_allowed", "robots_rule"),
    "tokenize": lambda s, d: _docs(s, d).select("doc_id", F.md5(F.array_join(X.tokenize(F.col("text")), " ")).alias("digest"), F.size(X.tokenize(F.col("text"))).alias("n_tokens")),
    "route_query": _route,
    "is_crm_query": lambda s, d: _asked(s, d).select("query_id", X.is_crm_query(F.col("query")).alias("is_crm")),
    "crm_intent": lambda s, d: _asked(s, d).select("query_id", X.crm_intent(F.col("query")).alias("intent")),
    "crm_entities": lambda s, d: _asked(s, d).select("query_id", F.explode(X.crm_entities(F.col("query"))).alias("e")).select("query_id", "e.*"),
    "date_tokens": lambda s, d: _docs(s, d).select("doc_id", F.array_join(X.date_tokens(F.col("text")), ",").alias("dates"), F.size(X.date_tokens(F.col("text"))).alias("n")),
    "strip_markdown": _markdown,
    "parser_dispatch": lambda s, d: _names(s, d).select("doc_id", X.parser_of(F.col("filename")).alias("parser")),
    "content_type": lambda s, d: _names(s, d).select("doc_id", X.content_type(F.col("filename")).alias("content_type")),
    "upload_validation": _upload,
    "pdf_date": _pdf,
    "html_title": lambda s, d: T.table(s, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title")),
    "safe_url": lambda s, d: T.table(s, d, "pages").select("page_id", X.is_safe_url(F.col("url")).alias("safe")),
    "url_filename": lambda s, d: T.table(s, d, "pages").select("page_id", X.url_filename(F.col("url")).alias("filename")),
    "content_hash": lambda s, d: _docs(s, d).select("doc_id", F.sha2("text", 256).alias("content_hash")),
    "entity_id": lambda s, d: T.table(s, d, "part").select("p_partkey", X.entity_id(F.col("p_brand"), F.lit("Organization")).alias("entity_id")),
    "regex_entities": _entities,
    "topics_normalize": lambda s, d: _docs(s, d).select("doc_id", F.array_join(X.normalize_topics(F.split("text", "[.,]")), "|").alias("topics")),
    "llm_json": _llm_json,
    "page_count": lambda s, d: _docs(s, d).groupBy("source").agg(F.count("*").alias("n")).select("source", FM.page_count(F.col("n"), 10).alias("pages")),
}

_Q = "questions AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(i, q.replace("'", "''")) for i, q in enumerate(QUESTIONS)) + ") AS t(query_id, query))"
_ASKED = "asked AS (SELECT query_id, query FROM questions UNION ALL SELECT (item_id + 1000)::INT, text FROM benchmark)"
_any = lambda c, ps: "(" + " OR ".join("regexp_matches({}, '{}')".format(c, p.replace("'", "''")) for p in ps) + ")"
_ROUTE = f"CASE WHEN q = '' OR {_any('q', X.GREETING)} THEN 'greeting' WHEN {_any('q', X.IRRELEVANT)} THEN 'irrelevant' WHEN regexp_matches(q, '{X.DATE}') THEN 'hybrid' WHEN {_any('q', X.KEYWORD)} THEN 'keyword' WHEN {_any('q', X.SEMANTIC)} THEN 'semantic' ELSE 'hybrid' END"
_score = lambda ps: " + ".join("regexp_matches(q, '{}')::INT".format(p.replace("'", "''")) for p in ps)
_INTENT = ", ".join(f"{_score(ps)} AS s_{i}" for i, ps in X.CRM_INTENT.items())
_BEST = "greatest(" + ", ".join(f"s_{i}" for i in X.CRM_INTENT) + ")"
_FILES = "files AS (SELECT doc_id, source || '/' || doc_id || ['.PDF', '.docx', '.html', '.Htm', '.txt', '.md', '.exe', ''][doc_id % 8 + 1] AS filename, n_chars FROM documents), exts AS (SELECT *, lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) AS ext FROM files)"
_MD = "text0"
for _p, _r in X.MARKDOWN:
    _MD = "regexp_replace({}, '{}', '{}', 'g')".format(_MD, _p.replace("(?m)", "(?m)"), _r.replace("$1", "\\1"))
_ents = " UNION ALL ".join(
    f"SELECT doc_id, trim(unnest(n)) AS name, '{kind}' AS type, {c}::DOUBLE AS confidence, generate_subscripts(n, 1) + {k} * 1000000 AS place FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 1) AS n FROM documents)"
    for k, (p, kind, c) in enumerate(X.TEXT_ENTITY)
)
_ents += f" UNION ALL SELECT doc_id, unnest(n), 'CONCEPT', 0.4::DOUBLE, generate_subscripts(n, 1) + 5000000 FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '{X.ACRONYM[0]}')) AS n FROM documents)"
_crm_ents = " UNION ALL ".join(f"SELECT query_id, regexp_replace(trim(unnest(regexp_extract_all(query, '(?i){p}', 1))), '\\s+', ' ', 'g') AS name, '{k}' AS type FROM asked" for p, k in X.CRM_ENTITY)
_TOKENS = "list_transform(list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9]+'), lambda t: t <> ''), lambda t: lower(t))"

ORACLES = {
    "tokenize": f"SELECT doc_id, md5(array_to_string({_TOKENS}, ' ')) AS digest, len({_TOKENS})::INT AS n_tokens FROM documents",
    "route_query": f"WITH {_Q} SELECT query_id::INT AS query_id, {_ROUTE} AS query_type FROM (SELECT query_id, lower(trim(query)) AS q FROM questions UNION ALL SELECT item_id + 1000, lower(trim(text)) FROM benchmark)",
    "is_crm_query": f"WITH {_Q}, {_ASKED} SELECT query_id, {_any('lower(trim(query))', X.CRM_QUERY)} AS is_crm FROM asked",
    "crm_intent": f"WITH {_Q}, {_ASKED}, scored AS (SELECT query_id, {_INTENT} FROM (SELECT query_id, lower(trim(query)) AS q FROM asked)) SELECT query_id, CASE WHEN {_BEST} = 0 THEN 'none' " + " ".join(f"WHEN s_{i} = {_BEST} THEN '{i}'" for i in X.CRM_INTENT) + " END AS intent FROM scored",
    "crm_entities": f"WITH {_Q}, {_ASKED} SELECT query_id, name, type, 0.9::DOUBLE AS confidence FROM ({_crm_ents}) WHERE length(name) > 2",
    "date_tokens": f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{X.DATE}'), ',') AS dates, len(regexp_extract_all(text, '{X.DATE}'))::INT AS n FROM documents",
    "strip_markdown": f"SELECT doc_id, md5(regexp_replace({_MD}, '\\n{{3,}}', chr(10) || chr(10), 'g')) AS digest FROM (SELECT doc_id, '# ' || replace(text, chr(10), chr(10) || '- ') || chr(10) || '```code' || chr(10) || 'block```' || chr(10) || '**bold** and *it* [link](http://x) ~~gone~~ `x`' || chr(10) || '1. one' || chr(10) || '---' || repeat(chr(10), 4) || 'end' AS text0 FROM documents)",
    "parser_dispatch": f"WITH {_FILES} SELECT doc_id, CASE ext WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' WHEN '.txt' THEN 'text' WHEN '.md' THEN 'text' END AS parser FROM exts",
    "content_type": f"WITH {_FILES} SELECT doc_id, CASE ext " + " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in X.CONTENT_TYPES.items()) + " END AS content_type FROM exts",
    "upload_validation": f"WITH {_FILES} SELECT doc_id, (CASE WHEN size > 52428800 THEN 413 WHEN ext NOT IN ('.txt', '.md', '.pdf', '.docx', '.html', '.htm') THEN 415 WHEN declared = 'image/png' THEN 415 WHEN size = 0 THEN 400 END)::INT AS status FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'image/png' END AS declared, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 60000000 ELSE n_chars END AS size FROM exts)",
    "pdf_date": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 4 = 0 THEN '+00:00:' ELSE '' END WHEN event_id % 4 = 2 THEN strftime(ts, '%Y%m%d') ELSE strftime(ts, '%Y%m%d%H%M%S') END AS iso FROM events",
    "html_title": "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages",
    "safe_url": "SELECT page_id, regexp_matches(url, '(?i)^https?://') AND NOT (h IN ('localhost', '127.0.0.1', '::1') OR h LIKE '10.%' OR h LIKE '172.16.%' OR h LIKE '192.168.%') AS safe FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM pages)",
    "robots_judged": f"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)) AS origin, regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS p FROM pages),
u AS (SELECT page_id, origin, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM p), sites AS (SELECT origin, min(path) AS first FROM u GROUP BY origin),
robots AS (SELECT origin, CASE length(origin) % 4 WHEN 0 THEN '' WHEN 1 THEN 'User-agent: *' || chr(10) || 'Disallow: /en/1' || chr(10) || 'Disallow: /en' || chr(10) || 'Disallow:' || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10)
  WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || '# ours' || chr(10) || 'user-agent: {RB.AGENT.title()}' || chr(10) || 'disallow: /en/6' || chr(10) || 'Disallow:   ' || substr(first, 1, 5) END AS content FROM sites),
lines AS (SELECT origin, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM robots),
parsed AS (SELECT origin, lower(trim(split_part(line, ':', 1))) AS field, trim(substr(line, instr(line, ':') + 1)) AS value, i FROM lines WHERE contains(line, ':')),
owned AS (SELECT origin, field, value, last_value(CASE WHEN field = 'user-agent' THEN lower(value) END IGNORE NULLS) OVER (PARTITION BY origin ORDER BY i ROWS UNBOUNDED PRECEDING) AS who FROM parsed),
meant AS (SELECT DISTINCT origin, value AS rule, who FROM owned WHERE field = 'disallow' AND value <> '' AND who IN ('*', '{RB.AGENT}')),
rules AS (SELECT origin, rule FROM meant s WHERE who <> '*' OR NOT EXISTS (FROM meant o WHERE o.origin = s.origin AND o.who <> '*')),
hit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM u JOIN rules USING (origin) WHERE starts_with(path, rule) GROUP BY page_id)
SELECT page_id, CASE WHEN content IS NOT NULL THEN hit.rule IS NULL END AS robots_allowed, hit.rule AS robots_rule FROM u JOIN robots USING (origin) LEFT JOIN hit USING (page_id)""",
    "url_filename": "SELECT page_id, substr(replace(h, '.', '_') || '__' || CASE WHEN p = '' THEN 'index' ELSE p END || '.html', 1, 255) AS filename FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h, replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/', '_') AS p FROM pages)",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "entity_id": "SELECT p_partkey, substr(md5(lower(p_brand) || '|organization'), 1, 16) AS entity_id FROM part",
    "regex_entities": f"WITH e AS (SELECT *, substr(md5(lower(name) || '|' || lower(type)), 1, 16) AS entity_id FROM ({_ents}) WHERE length(name) >= 2) SELECT doc_id, entity_id, name, type, confidence FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, entity_id ORDER BY place) = 1",
    "topics_normalize": "SELECT doc_id, coalesce(string_agg(t, '|' ORDER BY i), '') AS topics FROM (SELECT doc_id, t, min(i) AS i FROM (SELECT doc_id, lower(trim(unnest(p))) AS t, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[.,]') AS p FROM documents)) WHERE t <> '' GROUP BY ALL) GROUP BY doc_id",
    "llm_json": "SELECT item_id, CASE WHEN item_id % 3 < 2 THEN regexp_replace(text, '[^a-zA-Z ]', '', 'g') END AS answer_text, CASE WHEN item_id % 3 < 2 THEN (item_id % 10) / 10.0::DOUBLE END AS confidence FROM benchmark",
    "page_count": "SELECT source, greatest(1, ceil(count(*) / 10.0))::BIGINT AS pages FROM documents GROUP BY source",
}
