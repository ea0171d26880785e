"""Operations on a table of chunks; each is a new version of the table, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_ref, strip, token_count


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    by = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def current_chunks(chunks: DataFrame) -> DataFrame:
    """Each chunk id once, as delivered last, with the file id normalised."""
    return latest(chunks.withColumn("file_id", norm_ref(F.col("file_id"))), ["id"], [F.desc("updated_at"), F.desc("created_at"), F.desc("chunk_index"), "file_id"])


def numbered(chunks: DataFrame) -> DataFrame:
    """``pos``: place of each chunk within its knowledge base's file, from 0."""
    by = W.partitionBy("knowledge_id", "file_id").orderBy("chunk_index", "id")
    return chunks.withColumn("pos", (F.row_number().over(by) - 1).cast("bigint"))


def merge_range(chunks: DataFrame, start: int, end: int) -> DataFrame:
    """Chunks ``start`` to ``end`` of every file that has them all become one; later ones move up.

    The merged chunk keeps the first one's meta; a file with fewer chunks is left as it is.
    """
    keys = ["knowledge_id", "file_id"]
    sized = chunks.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    inside = (F.col("_n") > end) & F.col("pos").between(start, end)
    merged = sized.where(inside).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "content", "meta"))).alias("p"))
    merged = merged.select(F.sha2(F.concat_ws("|", F.col("p")[0]["id"], F.lit("merged")), 256).alias("id"), *keys, F.lit(start).cast("bigint").alias("pos"), F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("content"), F.col("p")[0]["meta"].alias("meta"))
    rest = sized.where(~inside).withColumn("pos", F.when((F.col("_n") > end) & (F.col("pos") > end), F.col("pos") - (end - start)).otherwise(F.col("pos")))
    return rest.select("id", *keys, "pos", "content", "meta").unionByName(merged)


def split_chunk(chunks: DataFrame, at: Column, which: Column) -> DataFrame:
    """Each chunk for which ``which`` holds is cut at ``at`` into two stripped parts where both have text; later ones move down."""
    keys = ["knowledge_id", "file_id"]
    a, b = strip(F.substring("content", F.lit(1), at)), strip(F.substring("content", at + 1, F.length("content")))
    cut = which & (at > 0) & (at < F.length("content")) & (a != "") & (b != "")
    marked = chunks.withColumn("_cut", F.coalesce(cut, F.lit(False))).withColumn("_before", F.coalesce(F.sum(F.col("_cut").cast("int")).over(W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    parts = F.when(F.col("_cut"), F.array(F.struct(F.col("id"), F.lit(0).alias("o"), a.alias("content")), F.struct(F.sha2(F.concat_ws("|", "id", F.lit("split")), 256).alias("id"), F.lit(1).alias("o"), b.alias("content")))).otherwise(F.array(F.struct(F.col("id"), F.lit(0).alias("o"), F.col("content"))))
    return marked.select(*keys, "meta", (F.col("pos") + F.col("_before")).alias("_at"), F.explode(parts).alias("p")).select(F.col("p.id").alias("id"), *keys, (F.col("_at") + F.col("p.o")).cast("bigint").alias("pos"), F.col("p.content").alias("content"), "meta")


def replace_file_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the (knowledge base, file) pairs in ``new`` are replaced by its rows."""
    keys = ["knowledge_id", "file_id"]
    return chunks.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def reindex_meta(chunks: DataFrame) -> DataFrame:
    """The meta map of each chunk with file_id, chunk_index and content_hash put in (these win)."""
    own = F.create_map(F.lit("file_id"), F.col("file_id"), F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("content_hash"), F.sha2("content", 256))
    doc = F.from_json("meta", "map<string,string>")
    base = F.map_filter(F.coalesce(doc, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("file_id", "chunk_index", "content_hash"))
    return chunks.withColumn("meta_map", F.map_concat(base, own))


def with_derived(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("token_count", token_count(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))


def snapshot_documents(bases: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """A snapshot of each knowledge base: its files and chunks as one JSON document, with their numbers.

    The document is one value a knowledge base, as snapshots are stored; it holds no texts.
    """
    f = files.groupBy("knowledge_id").agg(F.count(F.lit(1)).alias("file_count"), F.array_sort(F.collect_list(F.struct("file_id", "filename", "directory_id"))).alias("files"))
    c = chunks.groupBy("knowledge_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.array_sort(F.collect_list(F.struct("id", "file_id", "chunk_index", "content_hash", "token_count"))).alias("chunks"))
    both = bases.join(f, "knowledge_id", "left").join(c, "knowledge_id", "left")
    lists = [F.coalesce(F.col(n), F.array().cast(both.schema[n].dataType)).alias(n) for n in ("files", "chunks")]
    return both.select("knowledge_id", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.to_json(F.struct(*lists)).alias("snapshot_data"))
