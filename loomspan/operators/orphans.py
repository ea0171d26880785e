"""References to records that do not exist.

Parent keys become 128-bit integers, are sorted and compressed into runs of consecutive
integers; each distinct referenced key is matched as-of to the run that starts at or before
it, and a key beyond that run's end has no parent.

Keys. A reference is compared lower-cased and stripped of white space. A canonical decimal
number keeps its value (so dense numeric keys compress to few runs), a UUID is its 128-bit
value, any other text is the 128-bit value of its MD5 digest; the three kinds never meet.

Distribution. Runs never cross a *block* of 2^``BLOCK_BITS`` consecutive integers and are matched
within their block, which is spread by hash: no task sees more than a block's keys of any one,
however dense or time-ordered keys are. A run is three integers. References are reduced to one
row per distinct key before that, map side first: a key that a third of all records name is one
row. Younger parents come from a join on the key itself, for which both sides are already in
place. The records are then joined with the keys that have no parent (or a younger one) only,
salted, so a hot missing key is spread over ``SALTS`` tasks.

Results for odd input: NULL or blank references are no cases; NULL ``created_at`` of a record
gives a NULL period and is never ``late``; a parent with only NULL ``created_at`` is never
younger; repeated parents count with their earliest ``created_at``; repeated records come out
once; an empty parent table makes every reference missing; an empty child table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_ref, utc_month
from ..sources.shared import materialize

#: Keys that a run has at most, as a power of two.
BLOCK_BITS = 16
#: Parts into which the records of one key are spread in the last join.
SALTS = 16


@dataclass(frozen=True)
class Child:
    """Records of ``df`` with their id and the column that refers to ``entity``."""

    name: str
    df: DataFrame
    id_col: str
    ref_col: str
    created_col: str
    entity: str


@dataclass(frozen=True)
class Parent:
    entity: str
    df: DataFrame
    id_col: str
    created_col: str


_KEY = ["entity", "kind", "hi", "lo"]
_BLOCK = ["entity", "kind", "hi", "block"]


def int_key(ref: Column) -> tuple[Column, Column, Column]:
    """The kind of a normalised reference and the high and low 64 bits of its 128-bit integer."""
    uuid = ref.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    hexed = F.when(uuid, F.replace(ref, F.lit("-"), F.lit(""))).otherwise(F.md5(ref))
    number = ref.rlike("^(0|[1-9][0-9]{0,17})$")
    hi = F.when(number, F.lit(0).cast("bigint")).otherwise(F.conv(F.substring(hexed, 1, 16), 16, -10).cast("bigint"))
    lo = F.when(number, ref.cast("bigint")).otherwise(F.conv(F.substring(hexed, 17, 16), 16, -10).cast("bigint"))
    return F.when(number, 0).when(uuid, 1).otherwise(2).cast("tinyint"), hi, lo


def _keyed(df: DataFrame, entity: str, ref: str, created: str, *more: Column) -> DataFrame:
    named = df.select(F.lit(entity).alias("entity"), norm_ref(F.col(ref).cast("string")).alias("ref"), F.col(created).cast("bigint").alias("created"), *more)
    kind, hi, lo = int_key(F.col("ref"))
    return named.where(F.col("ref").isNotNull()).withColumn("kind", kind).withColumn("hi", hi).withColumn("lo", lo).drop("ref")


def parent_keys(parents: list[Parent]) -> DataFrame:
    """Each parent key once, with its earliest ``parent_created``."""
    keys = reduce(DataFrame.unionByName, [_keyed(p.df, p.entity, p.id_col, p.created_col) for p in parents])
    return keys.groupBy(*_KEY).agg(F.min("created").alias("parent_created"))


def key_runs(keys: DataFrame) -> DataFrame:
    """Runs of consecutive keys within their blocks: lo (start) and run_end."""
    blocks = keys.select(*_KEY, F.shiftright("lo", BLOCK_BITS).alias("block"))
    by = W.partitionBy(*_BLOCK).orderBy("lo")
    fresh = F.when(F.lag("lo").over(by) + 1 == F.col("lo"), 0).otherwise(1)
    runs = blocks.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*_BLOCK, "run").agg(F.min("lo").alias("lo"), F.max("lo").alias("run_end"))


def beyond_runs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """The distinct referenced keys that lie beyond the end of the run before them, or have none before."""
    both = runs.select(*_BLOCK, "lo", F.lit(0).alias("turn"), "run_end")
    both = both.unionByName(refs.select(*_KEY, F.shiftright("lo", BLOCK_BITS).alias("block"), F.lit(1).alias("turn"), F.lit(None).cast("bigint").alias("run_end")))
    by = W.partitionBy(*_BLOCK).orderBy("lo", "turn").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("at", F.last("run_end", ignorenulls=True).over(by)).where("turn = 1")
    return found.where(F.col("at").isNull() | (F.col("lo") > F.col("at"))).select(*_KEY)


def orphan_references(children: list[Child], parents: list[Parent], deletions: DataFrame | None = None) -> DataFrame:
    """Records whose reference has no parent, or one created later.

    ``deletions`` has ``entity`` and ``entity_id``. Gives distinct child_table, record_id,
    reason (``missing``, ``deleted``, ``late``), period (UTC month of the record).
    """
    records = reduce(
        DataFrame.unionByName,
        [_keyed(c.df, c.entity, c.ref_col, c.created_col, F.lit(c.name).alias("child_table"), F.col(c.id_col).cast("string").alias("record_id")) for c in children],
    )
    # Both are needed twice: written once, a narrow row a distinct key.
    refs = materialize(records.groupBy(*_KEY).agg(F.min("created").alias("first_child")))
    keys = materialize(parent_keys(parents))
    absent = beyond_runs(refs, key_runs(keys))
    if deletions is not None:
        gone = _keyed(deletions.withColumn("created", F.lit(None).cast("bigint")), "", "entity_id", "created", F.lower("entity").alias("of")).select(F.col("of").alias("entity"), "kind", "hi", "lo", F.lit(True).alias("gone")).distinct()
        absent = absent.join(gone, _KEY, "left")
    else:
        absent = absent.withColumn("gone", F.lit(False))
    absent = absent.select(*_KEY, F.lit(None).cast("bigint").alias("parent_created"), F.when(F.col("gone"), "deleted").otherwise("missing").alias("reason"))
    younger = refs.join(keys, _KEY).where("first_child < parent_created").select(*_KEY, "parent_created", F.lit("late").alias("reason"))
    bad = absent.unionByName(younger)
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = records.withColumn("salt", F.pmod(F.xxhash64("record_id", "child_table"), F.lit(SALTS)).cast("int"))
    out = salted.join(bad, [*_KEY, "salt"])
    out = out.where((F.col("reason") != "late") | (F.col("created") < F.col("parent_created")))
    return out.select("child_table", "record_id", "reason", utc_month(F.col("created")).alias("period")).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Numbers of orphans per table, period and reason."""
    return orphans.groupBy("child_table", "period", "reason").agg(F.count(F.lit(1)).alias("n_records"))
