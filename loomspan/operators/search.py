"""Search, scopes, access and order over catalogues, composed before counting and paging.

Filters are plain predicates and semi-joins, so they reach the scan and nothing is joined for a
count that only needs ids. Results for odd input: NULL owners and names match nothing; an empty
search text means no filter; a NULL scope key means the rows without directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import contains_any, is_local, page

#: Rows of a page of knowledge bases and of files where the caller names none.
PAGE, FILE_PAGE = 30, 50


def with_owner(df: DataFrame, users: DataFrame, owner: str = "user_id") -> DataFrame:
    """Each row with its owner's user_name, user_email and username, NULL where there is none."""
    u = users.select(F.col("id").alias("_u"), F.col("name").alias("user_name"), F.col("email").alias("user_email"), "username")
    return df.join(u, df[owner] == u["_u"], "left").drop("_u")


def accessible(df: DataFrame, grants: DataFrame, user: str, groups: list[str], permission: str = "read", admin: bool = False, owner: str = "user_id") -> DataFrame:
    """Rows an admin, their owner or a holder of a grant (resource_id, kind, grantee, permission) may see; a write grant lets read."""
    if admin:
        return df
    holds = ((F.col("kind") == "user") & (F.col("grantee") == user)) | ((F.col("kind") == "group") & F.col("grantee").isin(groups or [""]))
    may = holds & (F.col("permission").isin("read", "write") if permission == "read" else (F.col("permission") == permission))
    named = grants.where(may).select(F.col("resource_id").alias("id")).distinct()
    mine = F.coalesce(F.col(owner) == user, F.lit(False))
    return df.where(mine).unionByName(df.where(~mine).join(named, "id", "left_semi").select(df.columns))


def viewed(df: DataFrame, view: str | None, me: str, owner: str = "user_id") -> DataFrame:
    """``created`` by me, ``shared`` by others (rows without owner are in neither), or all."""
    if view == "created":
        return df.where(F.col(owner) == me)
    return df.where(F.col(owner) != me) if view == "shared" else df


def of_source(df: DataFrame, source: str | None) -> DataFrame:
    if source == "local":
        return df.where(is_local(F.col("meta")))
    return df.where(F.get_json_object("meta", "$.source") == source) if source else df


def in_directory(df: DataFrame, scope: dict) -> DataFrame:
    """No key ``directory_id``: all rows; a value: that directory; None: rows without directory."""
    if "directory_id" not in scope:
        return df
    return df.where(F.col("directory_id") == scope["directory_id"]) if scope["directory_id"] else df.where(F.col("directory_id").isNull())


def search_bases(bases: DataFrame, users: DataFrame, text: str | None = None, view: str | None = None, me: str = "", source: str | None = None) -> DataFrame:
    """Knowledge bases whose name, description or owner's name, email or username contains ``text``."""
    rows = with_owner(of_source(viewed(bases, view, me), source), users)
    return rows.where(contains_any(text, "name", "description", "user_name", "user_email", "username")) if text else rows


def paged(df: DataFrame, order: list[Column], number: int = 1, size: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """(rows of a page, a row with the total before paging); pages under 1 are the first, sizes under 1 are 1."""
    size = max(1, size)
    return page(df, order, (max(1, number) - 1) * size, size), df.agg(F.count(F.lit(1)).alias("total"))


def file_order(order_by: str | None, direction: str | None) -> list[Column]:
    """Order of a file list: ``name``, ``created_at`` or ``updated_at``, else by ``updated_at`` downward; anything but ``asc`` is downward; ties by id."""
    named = {"name": "filename", "created_at": "created_at", "updated_at": "updated_at"}
    col = F.col(named.get(order_by or "", "updated_at"))
    up = direction == "asc" and order_by in named
    return [col.asc() if up else col.desc(), F.col("id")]
