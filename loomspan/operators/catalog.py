"""Search, paging and access over catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_any(query: str, *cols: str) -> Column:
    """Case-insensitive search in any of the columns; ``%`` and ``_`` in the query are wild."""
    hits = [F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in cols]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def glob(pattern: str) -> str:
    """A file pattern (``*``, ``?``) as a LIKE pattern."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return escaped.replace("*", "%").replace("?", "_")


def page(df: DataFrame, order: list[Column], skip: int | None = None, limit: int | None = None) -> DataFrame:
    """A page of an ordered table; no or zero ``limit`` means all."""
    out = df.orderBy(*order)
    if skip:
        out = out.offset(skip)
    return out.limit(limit) if limit else out


def is_local(meta: Column) -> Column:
    """Not marked external: true without meta, NULL where meta names no source."""
    return meta.isNull() | (F.get_json_object(meta, "$.source") != "external")


def readable(df: DataFrame, grants: DataFrame, user: str, id_col: str = "id", owner: str = "user_id") -> DataFrame:
    """Rows that ``user`` owns or that a grant (resource_id, grantee) names."""
    mine = grants.where(F.col("grantee") == user).select(F.col("resource_id").alias(id_col)).distinct().withColumn("_granted", F.lit(True))
    return df.join(mine, id_col, "left").where((F.col(owner) == user) | F.col("_granted")).drop("_granted")


def content_route(content_type: Column, name: Column) -> Column:
    """How an upload is processed, by its type and name."""
    text_name = name.rlike(r"(?i)\.(txt|md|csv|json|ya?ml|log|py|ts|js)$")
    return F.when(content_type.rlike("^(image|video)/") & text_name, "process").when(content_type.startswith("audio/"), "transcribe").when(content_type.startswith("video/"), "skip").when(content_type.startswith("image/"), "error").otherwise("process")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_")
