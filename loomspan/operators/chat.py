"""Operators over messages, their parts and what tools and models answer.

Messages are rows of ``conv`` and ``pos``. Results for odd input: NULL contents, calls and ids match
nothing and are kept as they are; equal positions keep both rows; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..sources.shared import materialize
from .retrieval import source_numbers

_MENTION = r"<(?:\$([^|>]+)(?:\|[^>]*)?|/([^|>]+)\|[^>]*)>"
_MENTION_LABEL = r"<(?:\$[^|>]+(?:\|([^>]*))?|/[^|>]+\|([^>]*))>"
#: What a stored message keeps for a model.
MESSAGE_KEYS = ("id", "role", "content", "output", "files", "contextSummary")
#: Parameters that are the console's own.
OWN_PARAMS = ("stream_response", "stream_delta_chunk_size", "function_calling", "reasoning_tags", "compact_token_threshold", "system", "note_id")
#: Characters of a fetched page that a citation shows, and of a document that a step gets.
SNIPPET, DOCUMENT_CHARS, RETRIEVED = 500, 8000, 15


def sanitize_tool_pairs(messages: DataFrame, calls: str = "tool_calls", call_id: str = "tool_call_id") -> DataFrame:
    """Assistants' calls without a result and results without a call go; a message left without calls stays only with content.

    ``calls`` is an array of ids, ``call_id`` the id a tool message answers. Both sides meet in joins on
    (conversation, id), so a long conversation is spread over its ids.
    """
    own = ["conv", "pos"]
    asked = messages.where(F.col("role") == "assistant").select(*own, F.posexplode(calls).alias("_n", "_id")).where(F.coalesce("_id", F.lit("")) != "")
    answered = messages.where((F.col("role") == "tool") & (F.coalesce(call_id, F.lit("")) != "")).select("conv", F.col(call_id).alias("_id")).distinct()
    kept = asked.join(answered, ["conv", "_id"], "left_semi").groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_id"))), lambda x: x["_id"]).alias("_kept"))
    known = asked.select("conv", F.col("_id").alias("_known")).distinct()
    calling = (F.col("role") == "assistant") & (F.size(F.coalesce(F.col(calls), F.array().cast("array<string>"))) > 0)
    talk = messages.where(F.col("role") != "tool").join(kept, own, "left")
    talk = talk.where(~calling | F.col("_kept").isNotNull() | (F.coalesce("content", F.lit("")) != "")).withColumn(calls, F.when(calling, F.col("_kept")).otherwise(F.col(calls)))
    tools = messages.where(F.col("role") == "tool").join(known.withColumnRenamed("_known", call_id), ["conv", call_id], "left_semi")
    return talk.select(messages.columns).unionByName(tools.select(messages.columns))


def mention_ids(text: Column) -> Column:
    """Ids of ``<$id|label>`` and ``</id|label>``, each once."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(_MENTION), F.lit(g)) for g in (1, 2)])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def without_mentions(text: Column) -> Column:
    """Mentions replaced by their labels, then stripped; a text without any stays as it is."""
    return F.when(text.rlike(_MENTION_LABEL), strip(F.regexp_replace(text, _MENTION_LABEL, "$1$2"))).otherwise(text)


def text_parts(content: Column) -> Column:
    """Texts of a message: its content, or the text parts of a JSON list of parts."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.when(content.isNull(), F.array().cast("array<string>")).when(F.ltrim(content).startswith("[") & parts.isNotNull(), listed).otherwise(F.array(content))


def expand_outputs(messages: DataFrame, output: str = "output") -> DataFrame:
    """Assistants' stored output items (type, text, call_id, name, arguments) as messages of their own; other messages without them."""
    has = (F.col("role") == "assistant") & (F.size(F.coalesce(F.col(output), F.array().cast(messages.schema[output].dataType))) > 0)
    plain = messages.where(~F.coalesce(has, F.lit(False))).select("conv", "pos", F.lit(0).alias("part"), "role", "content", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"))
    item = messages.where(has).select("conv", "pos", F.posexplode(output).alias("part", "x"))
    is_result = F.col("x.type") == "function_call_output"
    text = F.when(F.col("x.type") == "function_call", F.col("x.arguments")).otherwise(F.col("x.text"))
    return plain.unionByName(item.select("conv", "pos", "part", F.when(is_result, "tool").otherwise("assistant").alias("role"), text.alias("content"), F.col("x.call_id").alias("call_id"), F.col("x.name").alias("name")))


def without_keys(fields: Column, *names: str) -> Column:
    """A map without these keys."""
    return F.map_filter(fields, lambda k, _: ~k.isin(*names))


def model_params(params: Column, custom: Column) -> Column:
    """Parameters without the console's own, overlaid by the custom ones; NULL values go."""
    base = F.map_filter(without_keys(params, *OWN_PARAMS), lambda k, _: ~F.map_contains_key(custom, k))
    return F.map_filter(F.map_concat(base, custom), lambda _, v: v.isNotNull())


def coerced(value: Column) -> Column:
    """Valid JSON as it is, any other text as a JSON string."""
    return F.when(F.get_json_object(value, "$").isNotNull() | (value == "null"), value).otherwise(F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r"^\{\"v\":|\}$", ""))


def overlaid(response: Column, events: Column) -> Column:
    """Fields of the events, overlaid by those of the response."""
    return F.map_concat(F.map_filter(events, lambda k, _: ~F.map_contains_key(response, k)), response)


def knowledge_files(items: Column) -> Column:
    """A model's knowledge (id, name, collection_name, collection_names) as files: one collection, several, or the item as it is."""

    def shaped(x: Column) -> Column:
        one, several = F.coalesce(x["collection_name"], F.lit("")) != "", F.size(F.coalesce(x["collection_names"], F.array().cast("array<string>"))) > 0
        none = F.lit(None).cast("array<string>")
        return F.struct(
            F.when(one, x["collection_name"]).when(~several, x["id"]).alias("id"), x["name"].alias("name"), F.when(~one & several, "collection").alias("type"),
            F.when(~one & several, x["collection_names"]).otherwise(none).alias("collection_names"), (one | several).alias("legacy"),
        )

    return F.transform(items, shaped)


def chains(messages: DataFrame, leaves: DataFrame) -> DataFrame:
    """The messages (id, parent_id and others) from the root to each leaf (id), as (leaf, place, message columns).

    Messages hold a segment of their way up, itself first, and where the next one begins; segments double
    each round, and each leaf takes one segment a round, so a chain of any depth takes as many rounds as its
    depth has bits. Only messages where a segment is still to begin are kept for the next round, and a way
    becomes rows at the end only. A missing parent ends a chain, a cycle ends where it would repeat. Ids are unique.
    """
    columns = [c for c in messages.columns if c != "parent_id"]
    number = F.lit(0).cast("bigint")
    nodes = messages.where(F.col("id").isNotNull()).select("id", F.nullif("parent_id", "id").alias("next"), F.array(F.struct(*columns)).alias("way"), F.lit(False).alias("loops"))
    at = materialize(leaves.where(F.col("id").isNotNull()).select(F.col("id").alias("leaf")).distinct().select("leaf", F.col("leaf").alias("next"), number.alias("size"), F.array().cast(f"array<struct<round: int, id: {messages.schema['id'].dataType.simpleString()}, start: bigint>>").alias("stops"), F.lit(False).alias("loops")))
    rounds, parts = 0, []
    while True:
        begins = at.where("next IS NOT NULL").select(F.col("next").alias("id"))
        if begins.isEmpty():
            break
        needed = begins.unionByName(nodes.where("next IS NOT NULL").select(F.col("next").alias("id"))).distinct()
        nodes = materialize(nodes.join(needed, "id", "left_semi"))
        parts.append(nodes.join(begins.distinct(), "id", "left_semi").select(F.lit(rounds).alias("round"), "id", "way"))
        on = nodes.select(F.col("id").alias("next"), F.col("next").alias("far"), F.size("way").alias("more"), F.col("loops").alias("also"))
        stop = F.array(F.struct(F.lit(rounds).alias("round"), F.col("next").alias("id"), F.col("size").alias("start")))
        here = F.col("more").isNotNull()
        at = materialize(at.join(on, "next", "left").select("leaf", F.col("far").alias("next"), (F.col("size") + F.coalesce("more", number)).alias("size"), F.when(here, F.concat("stops", stop)).otherwise(F.col("stops")).alias("stops"), (F.col("loops") | F.coalesce("also", F.lit(False))).alias("loops")))
        on = nodes.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("way").alias("more"), F.col("loops").alias("also"))
        seen = F.transform("way", lambda x: x["id"])
        rest = F.filter("more", lambda x: ~F.array_contains(seen, x["id"]))
        repeats = F.coalesce(F.arrays_overlap(seen, F.transform("more", lambda x: x["id"])), F.lit(False))
        grown = nodes.join(on, "next", "left")
        nodes = grown.select("id", F.when(~repeats, F.col("far")).alias("next"), F.when(F.col("more").isNull(), F.col("way")).when(repeats, F.concat("way", rest)).otherwise(F.concat("way", "more")).alias("way"), (F.col("loops") | repeats | F.coalesce("also", F.lit(False))).alias("loops"))
        rounds += 1
    if not parts:
        return messages.select(F.col("id").alias("leaf"), number.alias("place"), *columns).where("false")
    ways = parts[0]
    for part in parts[1:]:
        ways = ways.unionByName(part)
    stops = at.select("leaf", "size", "loops", F.explode("stops").alias("s")).select("leaf", "size", "loops", "s.*")
    rows = stops.join(ways, ["round", "id"]).select("leaf", "size", "loops", "start", F.posexplode("way").alias("pos", "m")).withColumn("distance", F.col("start") + F.col("pos"))
    out = rows.where("NOT loops").select("leaf", (F.col("size") - F.col("distance")).alias("place"), "m.*")
    if at.where("loops").isEmpty():
        return out
    once = rows.where("loops").groupBy("leaf", F.col("m.id").alias("_id")).agg(F.min_by("m", "distance").alias("m"), F.min("distance").alias("distance"))
    place = F.row_number().over(W.partitionBy("leaf").orderBy(F.desc("distance"))).cast("bigint")
    return out.unionByName(once.select("leaf", place.alias("place"), "m.*"))


def citations(results: DataFrame) -> DataFrame:
    """Sources that a tool's result (call, tool, url, tool_id, result) is cited by: call, source_no, source_id, name, kind, doc_no, document.

    A result with an ``error`` gives none, nor does one whose shape isn't what its tool returns. Chunks
    of a knowledge query are grouped by file, note or source name, in order of appearance.
    """
    r = results.withColumn("_object", F.from_json("result", "map<string,string>")).withColumn("_list", F.when(F.ltrim("result").startswith("["), F.from_json("result", "array<map<string,string>>")))
    r = r.where(~F.coalesce(F.map_contains_key("_object", F.lit("error")), F.lit(False)))
    is_object = F.ltrim("result").startswith("{") & F.col("_object").isNotNull()
    none = F.lit(None).cast("string")

    def field(m: Column, name: str, default: str = "") -> Column:
        return F.coalesce(m[name], F.lit(default))

    listed = r.where(F.col("tool").isin("search_web", "query_knowledge_files") & F.col("_list").isNotNull()).select("call", "tool", F.posexplode("_list").alias("n", "x"))
    web = listed.where("tool = 'search_web'").select("call", F.lit(1).cast("bigint").alias("source_no"), F.lit("search_web").alias("source_id"), F.lit("search_web").alias("name"), none.alias("kind"), (F.col("n") + 1).cast("bigint").alias("doc_no"), F.concat(field(F.col("x"), "title"), F.lit("\n"), field(F.col("x"), "snippet")).alias("document"))
    chunk = listed.where("tool = 'query_knowledge_files'").select("call", "n", field(F.col("x"), "source", "Unknown").alias("name"), F.coalesce(F.nullif(field(F.col("x"), "file_id"), F.lit("")), field(F.col("x"), "note_id")).alias("ref"), field(F.col("x"), "type", "file").alias("kind"), field(F.col("x"), "content").alias("document"))
    chunk = source_numbers(chunk.withColumn("key", F.coalesce(F.nullif("ref", F.lit("")), "name")), "call", "n", "key")
    by = W.partitionBy("call", "number").orderBy("n")
    chunk = chunk.select("call", F.col("number").alias("source_no"), F.first("ref").over(by).alias("source_id"), F.first("name").over(by).alias("name"), F.first("kind").over(by).alias("kind"), F.row_number().over(by).cast("bigint").alias("doc_no"), "document")
    one = F.lit(1).cast("bigint")
    view = r.where(F.col("tool").isin("view_knowledge_file", "view_file") & is_object).select("call", one.alias("source_no"), field(F.col("_object"), "id").alias("source_id"), field(F.col("_object"), "filename", "Unknown File").alias("name"), F.lit("file").alias("kind"), one.alias("doc_no"), field(F.col("_object"), "content").alias("document"))
    url = F.coalesce(F.nullif("url", F.lit("")), F.lit("fetch_url"))
    cut = F.concat(F.substring("result", 1, SNIPPET), F.when(F.length("result") > SNIPPET, "...").otherwise(""))
    page = r.where("tool = 'fetch_url'").select("call", one.alias("source_no"), url.alias("source_id"), url.alias("name"), none.alias("kind"), one.alias("doc_no"), cut.alias("document"))
    named = F.col("tool").isin("search_web", "query_knowledge_files", "view_knowledge_file", "view_file", "fetch_url")
    other = r.where(~named).select("call", one.alias("source_no"), F.coalesce(F.nullif("tool_id", F.lit("")), "tool").alias("source_id"), F.col("tool").alias("name"), F.lit("tool").alias("kind"), one.alias("doc_no"), F.col("result").alias("document"))
    return web.unionByName(chunk).unionByName(view).unionByName(page).unionByName(other)


def source_tags(rows: DataFrame, owner: str, body: bool = True) -> DataFrame:
    """``<source>`` lines of each owner's documents (pos, document, source, name, kind, rid), numbered by first appearance; blank attributes are left out."""
    key = F.coalesce(F.nullif("source", F.lit("")), F.nullif("rid", F.lit("")), F.lit("N/A"))
    rows = source_numbers(rows.withColumn("_key", key), owner, "pos", "_key")

    def attribute(name: str, col: str) -> Column:
        return F.when(F.coalesce(F.col(col), F.lit("")) != "", F.concat(F.lit(f' {name}="'), F.col(col), F.lit('"'))).otherwise("")

    line = F.concat(F.lit('<source id="'), F.col("number"), F.lit('"'), attribute("name", "name"), attribute("resource-type", "kind"), attribute("resource-id", "rid"), F.lit(">"), F.coalesce("document", F.lit("")) if body else F.lit(""), F.lit("</source>\n"))
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return rows.groupBy(owner).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("context"))


def chosen_templates(sources: DataFrame, bases: DataFrame, default: str) -> DataFrame:
    """For each conversation the template of its first source (conv, pos, kb_id) whose knowledge base has one, else the default."""
    own = F.nullif(F.get_json_object("meta", "$.rag_prompt_template"), F.lit(""))
    filled = F.replace(F.replace(F.replace(own, F.lit("{query}"), F.lit("[query]")), F.lit("{context}"), F.lit("[context]")), F.lit("{kb_name}"), F.col("name"))
    k = bases.select(F.col("id").alias("kb_id"), filled.alias("template"))
    return sources.join(k, "kb_id", "left").groupBy("conv").agg(F.coalesce(F.min_by("template", F.when(F.col("template").isNotNull(), F.col("pos"))), F.lit(default)).alias("template"))


def rendered(template: Column, context: Column, query: Column) -> Column:
    """Place holders filled one after another: those inside the context are filled too."""
    out = template
    for mark, value in (("{{CONTEXT}}", context), ("[context]", context), ("{{QUERY}}", query), ("[query]", query)):
        out = F.replace(out, F.lit(mark), value)
    return out


def generated_queries(reply: Column, last_message: Column) -> Column:
    """Search queries in a model's reply: those of its last JSON object, else the reply itself, else the last message."""
    tail = F.regexp_extract(reply, r"(?s)(\{[^{]*)$", 1)
    sliced = F.when(reply.contains("{"), F.regexp_extract(tail, r"(?s)^(.*\})", 1)).otherwise(reply)
    listed = F.from_json(sliced, "queries array<string>")["queries"]
    valid = reply.contains("{") & F.get_json_object(sliced, "$").isNotNull()
    found = F.when(valid, F.coalesce(listed, F.array().cast("array<string>"))).when(reply.isNotNull(), F.array(sliced)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.coalesce(last_message, F.lit(""))))


def judged_claims(reply: Column) -> Column:
    """Claims in a judge's reply: from its fenced block if there is one, the text from the first to the last brace; NULL if that is no JSON."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(reply.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced).otherwise(reply)
    return F.from_json(F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit("")), "claims array<struct<text:string,supported:string,evidence:string>>")["claims"]


def retriever_texts(hits: DataFrame, files: DataFrame) -> DataFrame:
    """What a step's retriever gives (conv): the best ``RETRIEVED`` hits (rank, file_id, chunk_index, content) by file.

    Files come in order of their best hit, their chunks in order of the file; a file's text is cut at
    ``DOCUMENT_CHARS``. The header counts all hits, empty ones too; those have no part in a file.
    """
    top = hits.where(F.col("rank") <= RETRIEVED).withColumn("file_id", F.coalesce("file_id", F.lit("")))
    n_hits = top.groupBy("conv").agg(F.count(F.lit(1)).alias("n_hits"))
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("chunk_index", F.col("rank") - 1).alias("i"), "rank", "content")))
    docs = top.where(F.coalesce("content", F.lit("")) != "").groupBy("conv", "file_id").agg(F.min("rank").alias("best"), F.concat(F.lit("\n"), F.array_join(F.transform(parts, lambda x: x["content"]), "\n")).alias("body"))
    docs = docs.withColumn("no", F.row_number().over(W.partitionBy("conv").orderBy("best")))
    docs = docs.join(files.select(F.col("id").alias("file_id"), "filename"), "file_id", "left")
    src = F.coalesce("filename", F.when(F.col("file_id") != "", F.substring("file_id", 1, 20)).otherwise("Unknown"))
    text = F.concat(F.lit("\n=== Document "), F.col("no"), F.lit(": "), src, F.lit(" ===\n"), F.substring("body", 1, DOCUMENT_CHARS), F.lit("\n"))
    listed = docs.groupBy("conv").agg(F.count(F.lit(1)).alias("n_docs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", text.alias("t")))), lambda x: x["t"]), "").alias("texts"))
    head = F.concat(F.lit("[Retrieved "), F.col("n_hits"), F.lit(" chunks from "), F.coalesce("n_docs", F.lit(0)), F.lit(" documents]\n\n"))
    return n_hits.join(listed, "conv", "left").select("conv", F.concat(head, F.coalesce("texts", F.lit(""))).alias("output"))


def step_prompt(question: Column, outputs: Column, task: str) -> Column:
    """What a model step is sent: the question, earlier outputs (a map) of more than 5 characters, the task with its place holders filled."""
    told = F.filter(F.map_entries(outputs), lambda e: (e["key"] != "query") & (F.length(e["value"]) > 5))
    context = F.array_join(F.transform(told, lambda e: F.concat(F.lit("["), e["key"], F.lit("]: "), F.substring(e["value"], 1, 6000))), "\n")
    # The words around the parts.
    text = F.concat(F.lit("用户问题："), question, F.lit("\n\n"), F.when(context != "", F.concat(F.lit("前面步骤收集到的信息：\n"), context, F.lit("\n\n"))).otherwise(""), F.lit("你的任务：" + task))
    text = F.replace(F.replace(text, F.lit("{context}"), context), F.lit("{query}"), question)
    filled = F.aggregate(F.map_entries(outputs), text, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), F.substring(e["value"], 1, DOCUMENT_CHARS)))
    return F.substring(filled, 1, 10_000)


def picked(models: Column, seed: Column) -> Column:
    """One of an array of models, chosen by the seed's digest: as good as at random, and the same each time."""
    return F.element_at(F.array_sort(F.transform(models, lambda m: F.struct(F.md5(F.concat_ws("|", seed, m)).alias("d"), m.alias("m")))), 1)["m"]


def cited(sources: Column) -> Column:
    """Sources that can be shown: those with a name or an id."""
    return F.filter(sources, lambda s: ~(is_blank(s["name"]) & is_blank(s["id"])))
