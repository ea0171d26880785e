"""Folds over token and event deltas, in batch form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_DECODER = json.JSONDecoder()


def _json_objects_of(values: pd.Series) -> pd.Series:
    return values.map(_json_objects)


def parse_sse(line: Column) -> Column:
    """The JSON text of a server-sent line; NULL for blank lines, ``[DONE]`` and what isn't a JSON object."""
    body = F.trim(F.regexp_replace(line, r"^data:\s*", ""))
    parsed = F.from_json(body, "map<string,string>")
    return F.when(body.startswith("{") & parsed.isNotNull(), body)


def concat_deltas(deltas: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """All deltas of a key in order, as one text."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_t"))))
    return deltas.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), "").alias(text), F.count(F.lit(1)).alias("n_deltas"))


def batch_deltas(deltas: DataFrame, key: str, order: list[str], kind: str, size: int) -> DataFrame:
    """The last delta of every ``size`` of one kind in a row, and of each run's end."""
    by = W.partitionBy(key).orderBy(*order)
    runs = deltas.withColumn("_new", F.when(F.lag(kind).over(by).eqNullSafe(F.col(kind)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    inner = W.partitionBy(key, "run").orderBy(*order)
    placed = runs.withColumn("_n", F.row_number().over(inner)).withColumn("batch", F.floor((F.col("_n") - 1) / size))
    last = F.lead("_n").over(inner).isNull() | (F.col("_n") % size == 0)
    return placed.withColumn("_last", last).where("_last").drop("_last", "_new", "_n")


def assemble_calls(deltas: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Calls from their deltas: the last given name, all arguments in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce("arguments", F.lit("")).alias("a"))))
    return deltas.groupBy(*keys).agg(F.max_by("name", F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col(order))).alias("name"), F.array_join(F.transform(parts, lambda x: x["a"]), "").alias("arguments"))


def _json_objects(s: str | None) -> list[str] | None:
    out, at = [], 0
    s = (s or "").strip()
    while at < len(s):
        try:
            found, end = _DECODER.raw_decode(s, at)
        except ValueError:
            return None
        if not isinstance(found, dict):
            return None
        out.append(s[at:end])
        at = end
        while at < len(s) and s[at].isspace():
            at += 1
    return out or None


def split_json_objects(text: Column) -> Column:
    """Back-to-back JSON objects as an array of texts; NULL if there is anything else. Objects may nest and hold braces in strings."""
    return pandas_udf(_json_objects_of, "array<string>")(text)


def file_tags(messages: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The n-th message of a key meets its n-th stored file: ``<file .../>`` is put before its content; data URLs give none."""
    by = W.partitionBy(key).orderBy("pos")
    a = messages.withColumn("_n", F.row_number().over(by))
    b = stored.withColumn("_n", F.row_number().over(by)).select(key, "_n", "name", "url")
    tag = F.when(F.col("url").isNull() | F.col("url").startswith("data:"), F.lit("")).otherwise(F.concat(F.lit('<file name="'), F.coalesce("name", F.lit("")), F.lit('" url="'), F.col("url"), F.lit('"/>\n')))
    return a.join(b, [key, "_n"], "left").select(key, "pos", F.concat(tag, F.coalesce("content", F.lit(""))).alias("content"))


def steps_of(workflows: DataFrame, steps: DataFrame) -> DataFrame:
    """Each workflow with its steps in order, none for a workflow without."""
    listed = steps.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "agent_role"))).alias("steps"))
    return workflows.join(listed, workflows["id"] == listed["workflow_id"], "left").select("id", "name", F.coalesce("steps", F.array().cast(listed.schema["steps"].dataType)).alias("steps"))
