"""Changes of catalogue tables, each a new version of the tables it touches.

Every function takes whole tables and returns whole tables. Keys are matched by joins, so a
change of many rows costs one pass. Results for odd input: keys that match nothing change nothing;
repeated new rows count once; NULL keys match nothing; columns not named are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_rows(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with those of ``new`` whose key it lacks; missing columns are NULL."""
    fresh = new.dropDuplicates(key).join(table.select(*key).distinct(), key, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True).select(table.columns)


def update_rows(table: DataFrame, changes: DataFrame, key: list[str], now: Column) -> DataFrame:
    """Columns of ``changes`` that aren't NULL overwrite those of the rows of their key, which get ``updated_at``; one change a key."""
    cols = [c for c in changes.columns if c not in key]
    renamed = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    both = table.join(renamed, key, "left")
    value = {c: F.coalesce(f"_new_{c}", c) if c in cols else F.col(c) for c in table.columns}
    if "updated_at" in value and "updated_at" not in cols:
        value["updated_at"] = F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    return both.select(*[v.alias(c) for c, v in value.items()])


def delete_rows(table: DataFrame, keys: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows whose columns equal those of no key row; several pairs are joined by OR, one anti-join each."""
    for mine, theirs in on:
        gone = keys.where(F.col(theirs).isNotNull()).select(F.col(theirs).alias(mine)).distinct()
        table = table.join(gone, mine, "left_anti").select(table.columns)
    return table


def delete_bases(bases: DataFrame, dependents: list[DataFrame], ids: DataFrame) -> list[DataFrame]:
    """Knowledge bases and the rows of all tables that name them by knowledge_id, without those of ``ids``."""
    return [delete_rows(bases, ids, [("id", "id")]), *(delete_rows(d, ids, [("knowledge_id", "id")]) for d in dependents)]


def reset_base(bases: DataFrame, links: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(bases, links) after all links of the bases of ``ids`` are gone; those bases get ``updated_at``."""
    return update_rows(bases, ids.select("id").distinct(), ["id"], now), delete_rows(links, ids, [("knowledge_id", "id")])


def without_reference(models: DataFrame, array: str, ids: DataFrame) -> DataFrame:
    """Rows whose array of structs with an ``id`` lacks the elements that name one of ``ids``; order and NULL arrays are kept."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    found = models.select("id", F.explode(array).alias("_x")).select("id", F.col("_x.id").alias("_ref")).distinct()
    hit = found.join(gone, found["_ref"] == gone["_gone"], "left_semi").groupBy("id").agg(F.collect_set("_ref").alias("_refs"))
    kept = F.when(F.col("_refs").isNull(), F.col(array)).otherwise(F.filter(array, lambda x: ~F.coalesce(F.array_contains("_refs", x["id"]), F.lit(False))))
    return models.join(hit, "id", "left").withColumn(array, kept).select(models.columns)


def swap_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors after the texts of files changed: the new ones are added, then the old ids of those files go."""
    files = new.select("knowledge_id", "file_id").distinct()
    old = vectors.join(files, ["knowledge_id", "file_id"], "left_semi").select("id")
    return vectors.withColumn("_new", F.lit(False)).unionByName(new.select(vectors.columns).withColumn("_new", F.lit(True))).join(old.withColumn("_new", F.lit(False)), ["id", "_new"], "left_anti").select(vectors.columns)


def upload_row(name: Column, data_hash: Column, size: Column, allowed: list[str], max_bytes: int) -> Column:
    """What an upload is recorded as: base name, extension, status (``pending``, or why it is refused)."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    ext = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    status = F.when(~ext.isin(allowed), "type").when(size > max_bytes, "size").otherwise("pending")
    return F.struct(base.alias("filename"), ext.alias("extension"), data_hash.alias("hash"), status.alias("status"))


def metadata_text(name: Column, description: Column) -> Column:
    """The text a knowledge base is found by: name and description, or the name alone."""
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(name, F.lit("\n\n"), description)).otherwise(name)
