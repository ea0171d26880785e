"""External vector sources: their settings as maps, checked and cleaned, and their answers as rows.

Results for odd input: a setting that fails has its first error and no cleaned map; NULL maps are
empty; a provider is compared lower-cased and stripped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip

PROVIDERS = ("qdrant", "milvus", "pgvector")
# The settings each provider may have.
SOURCE_KEYS = {p: ["content_field", "metadata_field", "document_id_field", "vector_field"] for p in PROVIDERS}
SOURCE_KEYS["pgvector"] += ["table_name", "collection_field"]
CONNECTION_KEYS = {p: ["timeout"] for p in PROVIDERS}
CONNECTION_KEYS["milvus"] += ["db_name"]


def _allowed(config: Column, provider: Column, keys: dict[str, list[str]]) -> Column:
    names = F.coalesce(*[F.when(provider == p, F.array(*map(F.lit, k))) for p, k in keys.items()], F.array().cast("array<string>"))
    return F.map_filter(F.coalesce(config, F.create_map().cast("map<string,string>")), lambda k, _: F.array_contains(names, k))


def normal_source(kind: Column, name: Column, config: Column, provider: Column) -> Column:
    """error, name and config (allowed keys, stripped, blank ones left out) of a source."""
    kept = F.map_filter(F.transform_values(_allowed(config, provider, SOURCE_KEYS), lambda _, v: strip(v)), lambda _, v: v.isNotNull() & (v != ""))
    error = (
        F.when(F.coalesce(F.nullif(strip(kind), F.lit("")), F.lit("collection")) != "collection", "Only collection sources are supported.")
        .when(is_blank(name), "Collection name is required.")
        .when(~F.map_contains_key(kept, "content_field"), "Content field is required.")
        .when(provider.isin("milvus", "pgvector") & ~F.map_contains_key(kept, "vector_field"), "Vector field is required.")
    )
    return F.struct(error.alias("error"), strip(name).alias("name"), F.when(error.isNull(), kept).alias("config"))


def valid_connection(provider: Column, name: Column, endpoint: Column, config: Column) -> Column:
    """error, provider and config of a connection."""
    plain = F.lower(strip(provider))
    error = (
        F.when(~F.coalesce(plain.isin(*PROVIDERS), F.lit(False)), "Unsupported external knowledge provider.")
        .when(is_blank(name), "Knowledge source name is required.")
        .when(is_blank(endpoint), "Knowledge source endpoint is required.")
    )
    return F.struct(error.alias("error"), plain.alias("provider"), F.when(error.isNull(), _allowed(config, plain, CONNECTION_KEYS)).alias("config"))


def shown_connections(connections: DataFrame) -> DataFrame:
    """Connections without their secrets, with whether there are any."""
    return connections.withColumn("auth_configured", F.size(F.coalesce("auth_config", F.create_map().cast("map<string,string>"))) > 0).drop("auth_config")


def mapped_to(bases: DataFrame) -> DataFrame:
    """How many knowledge bases use each connection (``meta.external.connection_id``): one in use can't be deleted."""
    ref = F.get_json_object("meta", "$.external.connection_id")
    return bases.select(ref.alias("connection_id")).where("connection_id IS NOT NULL").groupBy("connection_id").agg(F.count(F.lit(1)).alias("n_bases"))
