"""What changed between consecutive full snapshots.

Each complete delivery is flattened to (record kind, key, canonical hash); a delivery and the
one before it meet in a full outer join on the primary key: a missing side is an addition or a
removal, unequal hashes are a change.

The canonical hash of an entry covers its non-null fields sorted by name, values as text with
numbers in one spelling, so absent equals null, ``"7"`` equals ``7`` and order is immaterial.

Distribution. Snapshot documents are parsed once and flattened where they are read; a narrow table
of keys and 16-byte hashes is written to the shared folder. The run of deliveries of one
knowledge base is ordered over a row a delivery, and given back as a running number that stands
for the delivery in all joins (broadcast while there are at most ``BROADCAST_DELIVERIES``). The outer
join is keyed by delivery and record, so one big knowledge base spreads; the newer side stays
where the grouping left it.

Results for odd input: NULL, truncated or non-object documents and labels without a number are
ignored; a missing list or NULL entry is empty; entries without a key are ignored; repeated entries count once;
one key with several different entries is compared as a set; the first delivery yields nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Deliveries whose running numbers (some 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_DELIVERIES = 200_000
#: Lists in a snapshot document with the record kind and key field of each.
LISTS = (("files", "file", "file_id"), ("chunks", "chunk", "id"))
_SCHEMA = ", ".join(f"{name} array<map<string,string>>" for name, _, _ in LISTS) + ", _bad string"


def delivery_number(label: Column) -> Column:
    """The first whole number in a label, full-width digits included; NULL if there is none."""
    plain = F.translate(label, "０１２３４５６７８９", "0123456789")
    return F.nullif(F.regexp_extract(plain, r"(\d+)", 1), F.lit("")).cast("decimal(38,0)")


def _canonical(value: Column) -> Column:
    number = value.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?$")
    return F.when(number, F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")).otherwise(value)


def _entry_hash(entry: Column, key: str) -> Column:
    fields = F.array_sort(F.filter(F.map_entries(entry), lambda e: (e["key"] != key) & e["value"].isNotNull()))
    text = F.array_join(F.transform(fields, lambda e: F.concat(e["key"], F.lit("\x01"), _canonical(e["value"]))), "\x02")
    return F.unhex(F.md5(text))


def _entries(name: str, kind: str, key: str) -> Column:
    given = F.filter(F.coalesce(F.col(f"doc.{name}"), F.array().cast("array<map<string,string>>")), lambda e: e.isNotNull() & F.element_at(e, key).isNotNull())
    return F.transform(given, lambda e: F.struct(F.lit(kind).alias("rec_kind"), F.element_at(e, key).alias("rec_id"), _entry_hash(e, key).alias("hash")))


def flatten_deliveries(snapshots: DataFrame) -> DataFrame:
    """id, knowledge_id, number, created_at, entries (distinct kind, key, hash) of complete numbered deliveries."""
    read = snapshots.select(
        F.col("id").cast("string").alias("id"), "knowledge_id", delivery_number(F.col("label")).alias("number"), F.col("created_at").cast("bigint").alias("created_at"),
        F.from_json("snapshot_data", _SCHEMA, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("doc"), F.rtrim(F.col("snapshot_data")).alias("raw"),
    )
    whole = F.col("doc").isNotNull() & F.col("doc._bad").isNull() & F.col("raw").rlike(r"(?s)^\s*\{.*\}\s*$")
    parts = [_entries(*x) for x in LISTS]
    return read.where(F.col("number").isNotNull() & whole).select("id", "knowledge_id", "number", "created_at", F.array_distinct(F.concat(*parts)).alias("entries"))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """knowledge_id, snapshot_id, rec_kind, rec_id, delta (``added``, ``removed``, ``changed``)."""
    flat = flatten_deliveries(snapshots).withColumn("at", F.coalesce("created_at", F.lit(-(2**62))))
    flat = materialize(flat.select("knowledge_id", "id", "number", "at", F.explode_outer("entries").alias("e")).select("knowledge_id", "id", "number", "at", "e.*"))
    deliveries = flat.groupBy("knowledge_id", "number").agg(F.max(F.struct("at", "id")).alias("top")).select("knowledge_id", "number", "top.at", "top.id")
    by = W.partitionBy("knowledge_id").orderBy("number")
    turns = materialize(deliveries.withColumn("turn", F.row_number().over(by)).withColumn("last", F.lead("number").over(by).isNull()))
    small = F.broadcast if turns.count() <= BROADCAST_DELIVERIES else (lambda df: df)

    chosen = small(turns.withColumnRenamed("knowledge_id", "kb").withColumnRenamed("id", "sid").withColumnRenamed("at", "t").withColumnRenamed("number", "n"))
    on = F.col("id").eqNullSafe(F.col("sid")) & F.col("knowledge_id").eqNullSafe(F.col("kb")) & (F.col("number") == F.col("n")) & (F.col("at") == F.col("t"))
    rows = flat.where("rec_id IS NOT NULL").join(chosen, on).select("knowledge_id", "turn", "last", "rec_kind", "rec_id", "hash")
    rows = rows.groupBy("knowledge_id", "turn", "rec_kind", "rec_id").agg(F.array_sort(F.collect_set("hash")).alias("hash"), F.first("last").alias("last"))
    new = rows.where("turn > 1").select("knowledge_id", "turn", "rec_kind", "rec_id", F.col("hash").alias("new_hash"))
    old = rows.where("NOT last").select(F.col("knowledge_id").alias("okb"), (F.col("turn") + 1).alias("oturn"), F.col("rec_kind").alias("okind"), F.col("rec_id").alias("orec"), F.col("hash").alias("old_hash"))
    same = F.col("knowledge_id").eqNullSafe(F.col("okb")) & (F.col("turn") == F.col("oturn")) & (F.col("rec_kind") == F.col("okind")) & (F.col("rec_id") == F.col("orec"))
    delta = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
    both = new.join(old, same, "full_outer").select(F.coalesce("knowledge_id", "okb").alias("knowledge_id"), F.coalesce("turn", "oturn").alias("turn"), F.coalesce("rec_kind", "okind").alias("rec_kind"), F.coalesce("rec_id", "orec").alias("rec_id"), delta.alias("delta")).where("delta IS NOT NULL")
    named = small(turns.select(F.col("knowledge_id").alias("kb"), F.col("turn").alias("k"), F.col("id").alias("snapshot_id")))
    return both.join(named, F.col("knowledge_id").eqNullSafe(F.col("kb")) & (F.col("turn") == F.col("k"))).select("knowledge_id", "snapshot_id", "rec_kind", "rec_id", "delta")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("knowledge_id", "snapshot_id", "rec_kind", "delta").agg(F.count(F.lit(1)).alias("n_records"))
