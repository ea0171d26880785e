"""Scores of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank


def retrieval_metrics(judgments: DataFrame, k: int = 10) -> DataFrame:
    """recall, precision (by ``k``) and mrr of each (knowledge_id, query_text) with a relevant chunk.

    Retrieved are the chunks judged at ranks 1 to ``k``; a NULL chunk counts as one relevant chunk that is
    never retrieved; ranks of 0 or NULL don't count for mrr. Copies of a judgment count once.
    """
    rel = F.col("relevance") == 1
    key = F.coalesce("chunk_id", F.lit("∅"))
    hit = rel & F.col("chunk_id").isNotNull() & F.col("rank_position").between(1, k)
    out = judgments.groupBy("knowledge_id", "query_text").agg(
        F.count_distinct(F.when(rel, key)).alias("n_relevant"), F.count_distinct(F.when(hit, F.col("chunk_id"))).alias("n_hit"), F.max(F.when(rel & (F.col("rank_position") > 0), 1.0 / F.col("rank_position"))).alias("best"),
    )
    return out.where("n_relevant > 0").select("knowledge_id", "query_text", "n_relevant", F.round(F.col("n_hit") / F.col("n_relevant"), 4).alias("recall"), F.round(F.col("n_hit") / k, 4).alias("precision"), F.round(F.coalesce("best", F.lit(0.0)), 4).alias("mrr"))


def upsert_judgments(judgments: DataFrame) -> DataFrame:
    """The last judgment of each (knowledge_id, query_text, chunk_id), NULL chunks being one."""
    by = W.partitionBy("knowledge_id", "query_text", "chunk_id").orderBy(F.desc("created_at"), F.desc("id"))
    return judgments.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def faithfulness(answer: Column, claims: Column) -> Column:
    """0 for a blank answer, 1 without claims, else the share of supported claims (4 places)."""
    n = F.size(F.coalesce(claims, F.array().cast("array<struct<text:string,supported:string,evidence:string>>")))
    yes = F.size(F.filter(claims, lambda c: c["supported"] == "yes"))
    return F.when(is_blank(answer), 0.0).when(n == 0, 1.0).otherwise(F.round(yes / n, 4))


def gate(items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Mean faithfulness over all items and whether it reaches ``threshold``; 0 without items."""
    mean = F.coalesce(F.round(F.avg("faithfulness"), 4), F.lit(0.0))
    return items.agg(F.count(F.lit(1)).alias("n_items"), mean.alias("mean_faithfulness"), (mean >= threshold).alias("passed"))
