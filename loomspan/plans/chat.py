"""Queries over messages, streams of deltas and answers of tools and models, with their SQL.

The tables hold no conversations, so events and evaluation rows are written as messages, in both
engines alike, before the operator reads them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat as H
from ..operators import folds as D
from ..operators import messages as M
from ..sources.tables import read_table as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_MSG = """msg AS (SELECT user_id AS conv, event_id AS pos, CASE event_type WHEN 'view' THEN 'user' WHEN 'purchase' THEN 'tool' WHEN 'signup' THEN 'system' ELSE 'assistant' END AS role,
CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || ' ' || event_id END AS content, CASE WHEN event_type = 'click' AND event_id % 3 > 0 THEN ['c' || (event_id % 11), 'c' || (event_id % 13)] ELSE [] END AS tool_calls, CASE WHEN event_type = 'purchase' THEN 'c' || (event_id % 17) END AS tool_call_id FROM events)"""


def _n(k: int) -> Column:
    return F.concat(F.lit("c"), (F.col("event_id") % k).cast("string"))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events as a conversation with tool calls and results."""
    kind = F.col("event_type")
    role = F.when(kind == "view", "user").when(kind == "purchase", "tool").when(kind == "signup", "system").otherwise("assistant")
    content = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat_ws(" ", kind, "event_id"))
    calls = F.when((kind == "click") & (F.col("event_id") % 3 > 0), F.array(_n(11), _n(13))).otherwise(F.array().cast("array<string>"))
    return t(spark, folder, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("pos"), role.alias("role"), content.alias("content"), calls.alias("tool_calls"), F.when(kind == "purchase", _n(17)).alias("tool_call_id"))


@query(f"""WITH {_MSG}, res AS (SELECT DISTINCT conv, tool_call_id AS c FROM msg WHERE role = 'tool'), asked AS (SELECT conv, pos, unnest(tool_calls) AS c FROM msg), known AS (SELECT DISTINCT conv, c FROM asked),
kept AS (SELECT a.conv, a.pos, count(*) AS n FROM asked a JOIN res USING (conv, c) GROUP BY ALL)
SELECT m.conv, m.pos, m.role, coalesce(k.n, 0) AS n_calls FROM msg m LEFT JOIN kept k ON k.conv = m.conv AND k.pos = m.pos
WHERE CASE WHEN m.role = 'tool' THEN EXISTS (SELECT 1 FROM known WHERE known.conv = m.conv AND known.c = m.tool_call_id) WHEN len(m.tool_calls) > 0 THEN k.n > 0 OR m.content <> '' ELSE true END""")
def tool_pairs_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    rows = H.sanitize_tool_pairs(_messages(spark, folder))
    return rows.select("conv", "pos", "role", F.coalesce(F.size(F.nullif("tool_calls", F.array().cast("array<string>"))), F.lit(0)).cast("bigint").alias("n_calls"))


_MENTION = "'<$skill-' || (event_id % 5) || '|Label ' || event_id || '> and </cmd-' || (event_id % 3) || '|run> ' || event_type || CASE WHEN event_id % 2 = 0 THEN ' <$skill-0>' ELSE '' END"


@query(f"SELECT event_id, list_sort(list_distinct(list_concat(['skill-' || (event_id % 5), 'cmd-' || (event_id % 3)], CASE WHEN event_id % 2 = 0 THEN ['skill-0'] ELSE [] END))) AS ids, 'Label ' || event_id || ' and run ' || event_type AS stripped FROM events")
def skill_mentions(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    text = F.concat(F.lit("<$skill-"), n % 5, F.lit("|Label "), n, F.lit("> and </cmd-"), n % 3, F.lit("|run> "), "event_type", F.when(n % 2 == 0, " <$skill-0>").otherwise(""))
    return t(spark, folder, "events").select("event_id", H.mention_ids(text).alias("ids"), H.without_mentions(text).alias("stripped"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [event_type] ELSE [event_type, '', props] END AS parts FROM events")
def message_text_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the messages are plain, half JSON lists with an image between the texts."""
    text = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    none = F.lit(None).cast("string")
    listed = F.to_json(F.array(text(F.col("event_type")), F.struct(F.lit("image_url").alias("type"), F.lit("x").alias("text")), text(none), text(F.col("props"))))
    content = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(listed)
    return t(spark, folder, "events").select("event_id", H.text_parts(content).alias("parts"))


_OUT = "out AS (SELECT id, context_chunks, unnest(range(0, len(context_chunks))) AS part, unnest(context_chunks) AS c FROM golden_set)"


@query(f"WITH {_OUT} SELECT id, part::INT AS part, CASE WHEN part % 3 = 2 THEN 'tool' ELSE 'assistant' END AS role, c.text AS content, CASE WHEN part % 3 > 0 THEN 'call-' || part END AS call_id FROM out UNION ALL SELECT id, 0, 'assistant', question, NULL FROM golden_set WHERE coalesce(len(context_chunks), 0) = 0 UNION ALL SELECT id, 0, 'user', question, NULL FROM golden_set")
def message_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Passages as stored output items of an answer: texts, calls and results."""
    kind = lambda i: F.when(i % 3 == 0, "message").when(i % 3 == 1, "function_call").otherwise("function_call_output")
    none = F.lit(None).cast("string")
    item = lambda c, i: F.struct(kind(i).alias("type"), c["text"].alias("text"), F.when(i % 3 > 0, F.concat(F.lit("call-"), i)).alias("call_id"), none.alias("name"), c["text"].alias("arguments"))
    g = t(spark, folder, "golden_set")
    said = g.select(F.col("id").alias("conv"), F.lit(1).alias("pos"), F.lit("assistant").alias("role"), F.col("question").alias("content"), F.transform("context_chunks", item).alias("output"))
    asked = g.select(F.col("id").alias("conv"), F.lit(0).alias("pos"), F.lit("user").alias("role"), F.col("question").alias("content"), F.transform("context_chunks", item).alias("output"))
    return H.expand_outputs(asked.unionByName(said)).select(F.col("conv").alias("id"), "part", "role", "content", "call_id")


def _entries(c: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


@query("SELECT event_id, 'kind=' || event_type || ',late=' || (event_id % 2) || ',n=' || event_id AS fields FROM events")
def event_merge(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    events = F.create_map(F.lit("late"), (F.col("event_id") % 2).cast("string"), F.lit("n"), F.lit("old"))
    return t(spark, folder, "events").select("event_id", _entries(H.overlaid(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("n"), n), events)).alias("fields"))


@query("SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN event_id % 3 > 0 THEN 'seed=' || event_id END, 'temperature=' || (event_id % 2), 'top_p=1'], lambda x: x IS NOT NULL)), ',') AS params FROM events")
def model_params(spark: SparkSession, folder: str) -> DataFrame:
    """Own parameters go, custom ones win, NULL ones go."""
    n = F.col("event_id")
    base = F.create_map(F.lit("system"), F.lit("x"), F.lit("temperature"), F.lit("9"), F.lit("note_id"), F.lit("7"), F.lit("seed"), F.when(n % 3 > 0, n.cast("string")), F.lit("top_p"), F.lit("1"))
    return t(spark, folder, "events").select("event_id", _entries(H.model_params(base, F.create_map(F.lit("temperature"), (n % 2).cast("string")))).alias("params"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '\"' || event_type || '\"' ELSE event_id::VARCHAR END AS value FROM events")
def custom_params(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    value = F.when(n % 3 == 0, F.col("props")).when(n % 3 == 1, F.col("event_type")).otherwise(n.cast("string"))
    return t(spark, folder, "events").select("event_id", H.coerced(value).alias("value"))


@query("SELECT id, CASE WHEN id[-1] = '1' THEN 'one' WHEN id[-1] = '2' THEN NULL ELSE id END AS file_id, CASE WHEN id[-1] = '2' THEN 'collection' END AS type, id[-1] IN ('1', '2') AS legacy FROM golden_set")
def knowledge_to_files(spark: SparkSession, folder: str) -> DataFrame:
    last = F.substring("id", -1, 1)
    item = F.struct("id", F.col("question").alias("name"), F.when(last == "1", "one").alias("collection_name"), F.when(last == "2", F.array(F.lit("a"), F.lit("b"))).alias("collection_names"))
    return t(spark, folder, "golden_set").select("id", F.get(H.knowledge_files(F.array(item)), F.lit(0)).alias("f")).select("id", F.col("f.id").alias("file_id"), "f.type", "f.legacy")


@query("""WITH g AS (SELECT id, question, context_chunks AS cs, id[-1]::INT % 5 AS k FROM golden_set WHERE len(context_chunks) > 0),
x AS (SELECT id, unnest(range(0, len(cs))) AS n, unnest(cs) AS c FROM g WHERE k = 0), w AS (SELECT id, unnest(range(0, len(cs))) AS n, unnest(cs) AS c FROM g WHERE k = 1),
q AS (SELECT *, coalesce(nullif(c.source, ''), 'Unknown') AS key, min(n) OVER (PARTITION BY id, coalesce(nullif(c.source, ''), 'Unknown')) AS f FROM x)
SELECT id AS call, dense_rank() OVER (PARTITION BY id ORDER BY f) AS source_no, coalesce(c.source, '') AS source_id, key AS name, row_number() OVER (PARTITION BY id, key ORDER BY n) AS doc_no, coalesce(c.text, '') AS document FROM q
UNION ALL SELECT id, 1, 'search_web', 'search_web', n + 1, coalesce(c.source, '') || chr(10) || coalesce(c.text, '') FROM w
UNION ALL SELECT id, 1, id, 'Unknown File', 1, question FROM g WHERE k = 2
UNION ALL SELECT id, 1, 'http://x/' || id, 'http://x/' || id, 1, substr(repeat(question, 9), 1, 500) || CASE WHEN length(repeat(question, 9)) > 500 THEN '...' ELSE '' END FROM g WHERE k = 3
UNION ALL SELECT id, 1, 'weather', 'weather', 1, question FROM g WHERE k = 4""")
def tool_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Passages as results of five tools; those of other shapes and with errors are mixed in and give nothing."""
    g = t(spark, folder, "golden_set").where(F.size("context_chunks") > 0).withColumn("k", F.substring("id", -1, 1).cast("int") % 5)
    chunk = F.to_json(F.transform("context_chunks", lambda c: F.struct(c["source"].alias("source"), c["source"].alias("file_id"), c["text"].alias("content"))))
    web = F.to_json(F.transform("context_chunks", lambda c: F.struct(c["source"].alias("title"), c["text"].alias("snippet"))))
    result = F.when(F.col("k") == 0, chunk).when(F.col("k") == 1, web).when(F.col("k") == 2, F.to_json(F.struct("id", F.col("question").alias("content")))).when(F.col("k") == 3, F.repeat("question", F.lit(9))).otherwise(F.col("question"))
    tool = F.element_at(F.array(*map(F.lit, ("query_knowledge_files", "search_web", "view_file", "fetch_url", "weather"))), F.col("k") + 1)
    rows = g.select(F.col("id").alias("call"), tool.alias("tool"), F.concat(F.lit("http://x/"), "id").alias("url"), F.lit("").alias("tool_id"), result.alias("result"))
    odd = g.select(F.concat(F.lit("odd-"), "id").alias("call"), F.when(F.col("k") > 1, "view_file").otherwise("search_web").alias("tool"), F.lit("").alias("url"), F.lit("").alias("tool_id"), F.when(F.col("k") > 2, '{"error": "x"}').when(F.col("k") > 1, "[]").otherwise("plain").alias("result"))
    return H.citations(rows.unionByName(odd)).drop("kind")


_SRC = """src AS (SELECT id, unnest(range(0, len(context_chunks))) AS pos, unnest(context_chunks) AS c FROM golden_set),
tag AS (SELECT *, coalesce(nullif(c.source, ''), CASE WHEN pos % 2 = 0 THEN id END, 'N/A') AS key FROM src), num AS (SELECT *, min(pos) OVER (PARTITION BY id, key) AS f FROM tag),
line AS (SELECT *, '<source id="' || dense_rank() OVER (PARTITION BY id ORDER BY f) || '"' || CASE WHEN coalesce(c.source, '') <> '' THEN ' name="' || c.source || '"' ELSE '' END || ' resource-type="file"' || CASE WHEN pos % 2 = 0 THEN ' resource-id="' || id || '"' ELSE '' END || '>' AS head FROM num)"""


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = t(spark, folder, "golden_set").select("id", F.posexplode("context_chunks").alias("pos", "c"))
    return rows.select("id", "pos", F.col("c.text").alias("document"), F.col("c.source").alias("source"), F.col("c.source").alias("name"), F.lit("file").alias("kind"), F.when(F.col("pos") % 2 == 0, F.col("id")).alias("rid"))


@query(f"WITH {_SRC} SELECT id, string_agg(head || coalesce(c.text, '') || '</source>' || chr(10), '' ORDER BY pos) AS context, string_agg(head || '</source>' || chr(10), '' ORDER BY pos) AS marks FROM line GROUP BY 1")
def source_tag_context(spark: SparkSession, folder: str) -> DataFrame:
    """Source tags with name, type and id where there are any, with and without bodies."""
    rows = _sources(spark, folder)
    return H.source_tags(rows, "id").join(H.source_tags(rows, "id", body=False).withColumnRenamed("context", "marks"), "id")


@query("""WITH k AS (SELECT id, name, CASE WHEN json_valid(meta) THEN nullif(meta->>'rag_prompt_template', '') END AS own FROM knowledge), k2 AS (SELECT id, coalesce(own, CASE WHEN user_id IS NULL THEN NULL ELSE '{kb_name}: {query}' END) AS tpl, name FROM (SELECT k.*, knowledge.user_id FROM k JOIN knowledge USING (id, name)))
SELECT g.id, replace(replace(coalesce(replace(replace(replace(k2.tpl, '{query}', '[query]'), '{context}', '[context]'), '{kb_name}', k2.name), '[context] -- [query]'), '[context]', 'C'), '[query]', g.question) AS prompt FROM golden_set g LEFT JOIN k2 ON k2.id = g.kb_id""")
def prompt_choose(spark: SparkSession, folder: str) -> DataFrame:
    """The template of the question's knowledge base if it has one, filled; owned bases without one get one here."""
    own = F.nullif(F.get_json_object("meta", "$.rag_prompt_template"), F.lit(""))
    tpl = F.coalesce(own, F.when(F.col("user_id").isNotNull(), "{kb_name}: {query}"))
    bases = t(spark, folder, "knowledge").select("id", "name", F.to_json(F.struct(tpl.alias("rag_prompt_template"))).alias("meta"))
    g = t(spark, folder, "golden_set")
    chosen = H.chosen_templates(g.select(F.col("id").alias("conv"), F.lit(0).alias("pos"), "kb_id"), bases, "[context] -- [query]")
    return g.join(chosen, g["id"] == chosen["conv"]).select("id", H.rendered(F.col("template"), F.lit("C"), F.col("question")).alias("prompt"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN [event_type, 'b'] WHEN 1 THEN [event_type] WHEN 2 THEN ['{broken}'] WHEN 3 THEN ['last'] ELSE ['last'] END AS queries FROM events")
def query_generation(spark: SparkSession, folder: str) -> DataFrame:
    """Queries from replies: JSON among words, no JSON, broken JSON, JSON without queries, no reply."""
    k = F.col("event_id") % 5
    reply = F.when(k == 0, F.concat(F.lit('Sure: {"queries": ["'), "event_type", F.lit('", "b"]} ok'))).when(k == 1, F.col("event_type")).when(k == 2, "so {broken} it is").when(k == 3, '{"other": 1}')
    return t(spark, folder, "events").select("event_id", H.generated_queries(reply, F.lit("last")).alias("queries"))


@query("SELECT DISTINCT result_id, coalesce(len(claims), 0) AS n_claims, coalesce(len(list_filter(claims, lambda c: c.supported = 'yes')), 0) AS n_yes FROM eval_result WHERE claims IS NOT NULL")
def judge_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Claims read again from replies with a fence, with words around them, and bare."""
    body = F.to_json(F.struct(F.transform("claims", lambda c: F.struct(c["text"].alias("text"), c["supported"].alias("supported"), c["evidence"].alias("evidence"))).alias("claims")))
    k = F.crc32("result_id") % 3
    reply = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone {x}"))).when(k == 1, F.concat(F.lit(" So: "), body, F.lit("."))).otherwise(body)
    rows = t(spark, folder, "eval_result").where("claims IS NOT NULL").select("result_id", H.judged_claims(reply).alias("c"))
    return rows.select("result_id", F.coalesce(F.size("c"), F.lit(0)).cast("bigint").alias("n_claims"), F.coalesce(F.size(F.filter("c", lambda x: x["supported"] == "yes")), F.lit(0)).cast("bigint").alias("n_yes")).distinct()


_CHAIN = "WITH RECURSIVE leaves AS (SELECT event_id AS leaf, event_id AS id, 0 AS d FROM events WHERE event_type = 'signup'), up AS (SELECT * FROM leaves UNION ALL SELECT leaf, id // 2, d + 1 FROM up WHERE id > 0)"


@query(f"{_CHAIN} SELECT leaf, row_number() OVER (PARTITION BY leaf ORDER BY d DESC) AS place, e.event_id AS id, e.event_type AS role FROM up JOIN events e ON e.event_id = up.id")
def message_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with parents (half their number): the chain from the root to each leaf, with the keys a model needs."""
    e = t(spark, folder, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") > 0, F.shiftright("event_id", 1)).alias("parent_id"), F.col("event_type").alias("role"))
    return H.chains(e, e.where("role = 'signup'")).select("leaf", "place", "id", "role")


@query("SELECT DISTINCT user_id, min_by(m, md5(user_id || '|' || m)) AS model FROM (SELECT DISTINCT user_id, event_type AS m FROM events WHERE event_type <> 'error') GROUP BY 1")
def arena_pick(spark: SparkSession, folder: str) -> DataFrame:
    """One of the models left after the excluded ones go."""
    models = t(spark, folder, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("m"))
    left = F.array_except("m", F.array(F.lit("error")))
    return models.where(F.size(left) > 0).select("user_id", H.picked(left, F.col("user_id").cast("string")).alias("model"))


@query("SELECT user_id, list(event_id ORDER BY event_id DESC) AS images FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0 GROUP BY 1")
def images_latest_first(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with an image, the latest first."""
    rows = t(spark, folder, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), F.col("event_id")))).alias("i"))
    return rows.select("user_id", F.reverse("i").alias("images")).where(F.size("images") > 0)


@query("SELECT user_id, sum((props->>'k')::BIGINT) AS total_tokens, arg_max(event_type, event_id) AS finish_reason, count(*) AS n_events FROM events GROUP BY 1")
def usage_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of tokens add up over a stream, other fields are those given last."""
    return t(spark, folder, "events").groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total_tokens"), F.max_by("event_type", "event_id").alias("finish_reason"), F.count(F.lit(1)).alias("n_events"))


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS said, arg_max(event_id, event_id) AS last_id, arg_max((props->>'k')::BIGINT, event_id) AS k FROM events GROUP BY 1")
def deltas_deep_merge(spark: SparkSession, folder: str) -> DataFrame:
    """JSON deltas merged: texts grow, numbers are replaced, objects merge at any depth."""
    rows = t(spark, folder, "events").select("user_id", "event_id", F.to_json(F.struct(F.struct(F.col("event_type").alias("said"), F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k")).alias("in")).alias("delta"), F.col("event_id").alias("id"))).alias("data"))
    out = D.merge_json(rows, "user_id", ["event_id"], "data")
    return out.select("user_id", F.get_json_object("result", "$.delta.said").alias("said"), F.get_json_object("result", "$.id").cast("bigint").alias("last_id"), F.get_json_object("result", "$.delta.in.k").cast("bigint").alias("k"))


@query("SELECT user_id, (event_id % 3)::INT AS index, string_agg(event_type, '' ORDER BY event_id) AS text, max(event_id) AS signature FROM events GROUP BY ALL")
def reasoning_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = t(spark, folder, "events").select("user_id", "event_id", F.to_json(F.struct((F.col("event_id") % 3).alias("index"), F.col("event_type").alias("text"), F.col("event_id").alias("signature"))).alias("data"))
    out = D.merge_reasoning(rows, "user_id", ["event_id"], "data")
    return out.select("user_id", F.explode(F.from_json("result", "array<struct<index:int,text:string,signature:bigint>>")).alias("x")).select("user_id", "x.*")


_SEQ = """seq AS (SELECT user_id, event_id, event_type, (CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) AS says FROM events)"""


@query(f"WITH {_SEQ} SELECT user_id, coalesce(string_agg(event_type, '' ORDER BY event_id) FILTER (WHERE says = 1), '') AS said, coalesce(string_agg(event_id::VARCHAR, '' ORDER BY event_id) FILTER (WHERE event_type = 'error'), '') AS arguments, true AS done FROM seq GROUP BY 1")
def responses_reduce(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events as the stream of a response: a message and a function call that grow by deltas, and its end."""
    e = t(spark, folder, "events").select("user_id", "event_id", "event_type")
    event = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    item = lambda kind: event(type=F.lit("response.output_item.added"), item=F.struct(F.lit(kind).alias("type")))
    kind = F.col("event_type")
    delta = (
        F.when(kind.isin("click", "view"), event(type=F.lit("response.output_text.delta"), output_index=F.lit(0), delta=kind))
        .when(kind == "error", event(type=F.lit("response.function_call_arguments.delta"), output_index=F.lit(1), delta=F.col("event_id").cast("string")))
        .when(kind == "signup", event(type=F.lit("response.reasoning_text.delta"), output_index=F.lit(0), delta=F.lit("no")))
        .otherwise(event(type=F.lit("response.in_progress")))
    )
    users = e.select("user_id").distinct()
    rows = e.select("user_id", F.lit(2).alias("turn"), "event_id", delta.alias("data"))
    ends = (("message", 0), ("function_call", 1))
    for name, turn in ends:
        rows = rows.unionByName(users.select("user_id", F.lit(turn).alias("turn"), F.lit(0).cast("bigint").alias("event_id"), item(name).alias("data")))
    rows = rows.unionByName(users.select("user_id", F.lit(3).alias("turn"), F.lit(0).cast("bigint").alias("event_id"), event(type=F.lit("response.completed"), response=F.struct(F.lit("r").alias("id"))).alias("data")))
    out = D.reduce_responses(rows, "user_id", ["turn", "event_id"], "data")
    got = lambda path: F.get_json_object("result", path)
    return out.select("user_id", F.coalesce(got("$.output[0].content[0].text"), F.lit("")).alias("said"), F.coalesce(got("$.output[1].arguments"), F.lit("")).alias("arguments"), (got("$.done") == "true").alias("done"))


@query("""WITH b AS (SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN [{'kind': 'reasoning', 'status': 'completed', 'text': event_type}, {'kind': 'message', 'status': 'completed', 'text': 'so ' || event_id}]
WHEN 1 THEN [{'kind': 'message', 'status': 'completed', 'text': 'a '}, {'kind': 'code_interpreter', 'status': 'completed', 'text': props}]
WHEN 2 THEN [{'kind': 'solution', 'status': 'in_progress', 'text': event_type}] ELSE [{'kind': 'message', 'status': 'completed', 'text': 'b'}] END) AS x FROM events) SELECT event_id, x.kind AS kind, x.status AS status, x.text AS text FROM b""")
def tag_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with nested, attributed, unterminated and empty tags."""
    k, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("<think> "), F.lit("<think>"), "event_type", F.lit("</think>so "), n))
        .when(k == 1, F.concat(F.lit('a <code_interpreter lang="py">\n'), "props", F.lit("</code_interpreter>")))
        .when(k == 2, F.concat(F.lit("<|begin_of_solution|>"), "event_type"))
        .otherwise("<reason> </reason>b")
    )
    return t(spark, folder, "events").select("event_id", F.explode(D.tag_blocks(text)).alias("x")).select("event_id", "x.kind", "x.status", "x.text")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN [props, '{\"a\": 1}'] WHEN event_id % 3 = 1 THEN [props] END AS arguments FROM events")
def call_arguments_split(spark: SparkSession, folder: str) -> DataFrame:
    """Arguments glued together, single, and broken (which give NULL: the caller keeps them as they are)."""
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat("props", F.lit('{"a": 1}'))).when(k == 1, F.col("props")).otherwise(F.concat("props", F.lit("{")))
    return t(spark, folder, "events").select("event_id", M.split_json_objects(raw).alias("arguments"))


@query("SELECT id, list_filter(list_transform(context_chunks, lambda c: c.source), lambda s: s IS NOT NULL AND s <> '') AS shown FROM golden_set WHERE context_chunks IS NOT NULL")
def citations_visible(spark: SparkSession, folder: str) -> DataFrame:
    named = F.transform("context_chunks", lambda c: F.struct(c["source"].alias("name"), F.lit(None).cast("string").alias("id")))
    return t(spark, folder, "golden_set").where("context_chunks IS NOT NULL").select("id", F.transform(H.cited(named), lambda s: s["name"]).alias("shown"))


@query("""WITH h AS (SELECT id, unnest(range(0, len(context_chunks))) AS i, unnest(context_chunks) AS c FROM golden_set), x AS (SELECT id AS conv, i + 1 AS rank, coalesce(c.source, '') AS file_id, i % 3 AS chunk_index, c.text AS content FROM h WHERE i < 15),
d AS (SELECT conv, file_id, min(rank) AS best, chr(10) || string_agg(content, chr(10) ORDER BY chunk_index, rank) AS body FROM x WHERE coalesce(content, '') <> '' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY best) AS no FROM d),
s AS (SELECT conv, count(*) AS n_docs, string_agg(chr(10) || '=== Document ' || no || ': ' || CASE WHEN file_id <> '' THEN left(file_id, 20) ELSE 'Unknown' END || ' ===' || chr(10) || left(body, 8000) || chr(10), '' ORDER BY no) AS texts FROM n GROUP BY 1)
SELECT t.conv AS id, '[Retrieved ' || t.n || ' chunks from ' || coalesce(s.n_docs, 0) || ' documents]' || chr(10) || chr(10) || coalesce(s.texts, '') AS output FROM (SELECT conv, count(*) AS n FROM x GROUP BY 1) t LEFT JOIN s USING (conv)""")
def retriever_output(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of each question as a step's retrieved text."""
    hits = t(spark, folder, "golden_set").select(F.col("id").alias("conv"), F.posexplode("context_chunks").alias("i", "c")).select("conv", (F.col("i") + 1).alias("rank"), F.col("c.source").alias("file_id"), (F.col("i") % 3).alias("chunk_index"), F.col("c.text").alias("content"))
    none = t(spark, folder, "file_record").select("id", "filename").where("false")
    return H.retriever_texts(hits, none).withColumnRenamed("conv", "id")


@query("""SELECT id, left('用户问题：' || question || chr(10) || chr(10) || '前面步骤收集到的信息：' || chr(10) || '[found]: ' || left(repeat(question, 9), 6000) || chr(10) || chr(10) || '你的任务：' || 'Answer ' || question || ' from ' || left(repeat(question, 9), 8000) || ' and -', 10000) AS prompt FROM golden_set WHERE question NOT LIKE '%{%' AND length(question) > 5""")
def step_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt of a model step after a step whose output is known and one whose output is too short to tell."""
    g = t(spark, folder, "golden_set").where("question NOT LIKE '%{%' AND length(question) > 5")
    outputs = F.create_map(F.lit("query"), F.col("question"), F.lit("found"), F.repeat("question", F.lit(9)), F.lit("note"), F.lit("-"))
    return g.select("id", H.step_prompt(F.col("question"), outputs, "Answer {query} from {found} and {note}").alias("prompt"))
