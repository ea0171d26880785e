"""Ranking by vectors and words, and what is made of ranked texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Query vectors that are broadcast at a time; more are ranked block after block.
QUERY_BLOCK = 4096
#: Items of a scope that are scored together.
ITEM_BLOCK = 16384
#: Cosines that are held at a time.
SCORES = 2_000_000


def _block_topk(ids: np.ndarray, groups: np.ndarray, matrix: np.ndarray, k: int, same_group: bool):
    norms = np.linalg.norm(matrix, axis=1)

    def best(asked: np.ndarray, own: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the best ``k`` rows of each asked query."""
        with np.errstate(invalid="ignore", divide="ignore"):
            sims = np.nan_to_num(matrix[asked] @ data.T / (norms[asked][:, None] * np.linalg.norm(data, axis=1)[None, :]))
        score = np.where(ids[asked][:, None] == own[None, :], -2.0, np.round(sims, 6))
        order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :k]
        q, c = np.repeat(np.arange(len(asked)), order.shape[1]), order.ravel()
        keep = score[q, c] > -2
        return asked[q[keep]], c[keep], score[q[keep], c[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ok = np.nonzero(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == matrix.shape[1])[0]
            own = batch.column(0).to_numpy(zero_copy_only=False)[ok]
            group = batch.column(1).to_numpy(zero_copy_only=False)[ok]
            data = np.array(lists.take(pa.array(ok)).to_pylist(), np.float64).reshape(len(ok), matrix.shape[1])
            everything = [(np.arange(len(ids)), np.arange(len(ok)))]
            shares = [(np.nonzero(groups == g)[0], np.nonzero(group == g)[0]) for g in np.intersect1d(groups, group)] if same_group else everything
            for asked, rows in shares:  # only rows of a query's own group are scored
                if len(asked) and len(rows):
                    q, c, score = best(asked, own[rows], data[rows])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[rows][c]), pa.array(score)], names=["query_id", "item_id", "score"])

    return run


def vector_topk(items: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", group: str = "label", same_group: bool = False) -> DataFrame:
    """The ``k`` items of the highest cosine for each query (itself left out), ties by id: query_id, item_id, score, rank.

    Queries go in blocks of bounded size against all items; every batch of items keeps its own
    best ``k`` a query before the final ranking. A query meets the items of its own vector length;
    vectors that are empty or NULL, and rows without an id, rank nowhere. Rows that repeat an id all count.
    """
    rows = items.select(F.col(id_col).cast("bigint"), F.col(group).cast("bigint"), vector).where(F.col(id_col).isNotNull())
    wanted = queries.select(F.col(id_col).cast("bigint").alias("q"), F.col(group).cast("bigint").alias("g"), F.col(vector).alias("v")).where("q IS NOT NULL AND size(v) > 0")
    parts: list[DataFrame] = []
    last = None
    while True:  # one bounded block of queries at a time
        block = (wanted if last is None else wanted.where(F.col("q") > last)).orderBy("q").limit(QUERY_BLOCK).collect()
        if not block:
            break
        last = block[-1]["q"]
        if len(block) == QUERY_BLOCK:  # more rows of the last id may follow
            block = [r for r in block if r["q"] != last] + wanted.where(F.col("q") == last).collect()
        for size in sorted({len(r["v"]) for r in block}):
            alike = [r for r in block if len(r["v"]) == size]
            run = _block_topk(np.array([r["q"] for r in alike]), np.array([-1 if r["g"] is None else r["g"] for r in alike]), np.array([r["v"] for r in alike], np.float64), k, same_group)
            parts.append(rows.mapInArrow(run, "query_id bigint, item_id bigint, score double"))
    if not parts:
        return rows.select(F.col(id_col).alias("query_id"), F.col(id_col).alias("item_id"), F.lit(0.0).alias("score"), F.lit(1).cast("bigint").alias("rank")).where("false")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _packed(texts: DataFrame, key: str, vocabulary: list[str]) -> DataFrame:
    """scope, ``key``, len (words of the text), and the words of the vocabulary among them: terms (their places) and tf (their numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, v = pa.array(vocabulary, pa.string()), max(1, len(vocabulary))
        for batch in batches:
            words = batch.column(3)
            term = pc.index_in(words.flatten(), value_set=known)
            there = term.is_valid().to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(words).to_numpy()[there].astype(np.int64)
            pairs, tf = np.unique(row * v + term.drop_null().to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(pairs // v, np.arange(len(batch) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (pairs % v, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *lists], names=["scope", key, "len", "terms", "tf"])

    words = texts.select("scope", key, words_of(F.col("text")).alias("w")).select("scope", key, F.when(F.col("w").isNotNull(), F.size("w")).alias("len"), "w")
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    return words.mapInArrow(run, f"scope {kinds['scope']}, {key} {kinds[key]}, len int, terms array<int>, tf array<int>")


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the best ``k`` of each row of a matrix; scores are rounded to 6 places, ties go by column, -inf is none."""
    m = scores.shape[1]
    least = np.partition(scores, m - k, axis=1)[:, m - k] if m > k else np.full(len(scores), -np.inf)
    row, col = np.nonzero((scores >= least[:, None] - 1e-6) & (scores > -np.inf))
    score = np.floor(scores[row, col] * 1e6 + 0.5) / 1e6
    order = np.lexsort((col, -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], score[keep]


def _ordered(items: pa.Table) -> tuple[pa.Table, pa.Array, np.ndarray]:
    """Items in the order of unit and id, the units there are and where each one's items begin and end."""
    items = items.take(pc.sort_indices(items, sort_keys=[("unit", "ascending"), ("item_id", "ascending")], null_placement="at_start")).combine_chunks()
    units = pc.unique(items["unit"].combine_chunks())
    code = pc.index_in(items["unit"], value_set=units).to_numpy()
    return items, units, np.searchsorted(code, np.arange(len(units) + 1))


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element of a column of lists."""
    column = table[name].combine_chunks()
    return pc.list_parent_indices(column).to_numpy(), column.flatten().to_numpy(zero_copy_only=False)


def _met(items: DataFrame, queries: DataFrame, sizes: DataFrame, n_items: int, score) -> DataFrame:
    """``score`` of the items and queries of each scope: query_id, item_id, score.

    A scope of more than ``ITEM_BLOCK`` items is cut into units by hash of the id, and its queries go to each
    of them; small scopes share a bucket. So no pair of an item and a query is ever a row, and a bucket
    holds about ``ITEM_BLOCK`` items.
    """
    spark = items.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_items // ITEM_BLOCK))
    large = F.broadcast(sizes.where(F.col("n") > ITEM_BLOCK).select("scope", F.ceil(F.col("n") / ITEM_BLOCK).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))

    def placed(df: DataFrame, part: Column) -> DataFrame:
        rows = df.join(large, "scope", "left").withColumn("_part", part)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("scope") + F.col("_part"), F.lit(n)).cast("int")).withColumn("unit", F.concat_ws(":", "_part", "scope"))
        return rows.drop("_part", "parts", "scope").repartition(n, "bucket")

    left = placed(items, F.pmod(F.xxhash64("item_id"), parts).cast("int"))
    right = placed(queries, F.explode(F.sequence(F.lit(0), parts - 1)))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "item_id": items.schema["item_id"].dataType.simpleString()}
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(score, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double")


def _found(items: pa.Table, queries: pa.Table, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    query, item, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))
    return pa.table({"query_id": queries["query_id"].take(pa.array(query.astype(np.int64))), "item_id": items["item_id"].take(pa.array(item.astype(np.int64))), "score": pa.array(score.astype(np.float64))})


def _bm25_scores(vocabulary: int, k: int, k1: float, b: float):
    v = max(1, vocabulary)

    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(items) or not len(queries):
            return _found(items, queries, [])
        items, units, begins = _ordered(items)
        code = np.repeat(np.arange(len(units)), np.diff(begins))
        asked = pc.fill_null(pc.index_in(queries["unit"], value_set=units), -1).to_numpy()
        mean = np.ones(len(units))
        mean[asked[asked >= 0]] = queries["avg_len"].to_numpy()[asked >= 0]
        row, term = _lists(items, "terms")
        tf, length = _lists(items, "tf")[1].astype(np.float64), items["len"].to_numpy().astype(np.float64)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean[code[row]]))
        by = np.argsort(key := code[row] * v + term, kind="stable")
        key, row, part = key[by], row[by], part[by]
        query, wanted = _lists(queries, "terms")
        idf = _lists(queries, "idf")[1]
        low, high = (np.searchsorted(key, asked[query] * v + wanted, side) for side in ("left", "right"))
        ends, found = np.searchsorted(query, np.arange(len(queries) + 1)), []
        for q in np.nonzero(asked >= 0)[0]:
            first, end = begins[asked[q]], begins[asked[q] + 1]
            total = np.zeros(end - first)
            for j in range(ends[q], ends[q + 1]):
                if low[j] < high[j]:
                    total[row[low[j] : high[j]] - first] += idf[j] * part[low[j] : high[j]]
            some = np.nonzero(total)[0]
            if len(some):
                _, col, score = _top(total[some][None, :], k)
                found.append((np.full(len(col), q), first + some[col], score))
        return _found(items, queries, found)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def bm25_topk(items: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 within a scope: items (scope, item_id, text), queries (scope, query_id, text) to query_id, item_id, score, rank.

    Only items that share a word and the scope with a query meet. Scores are rounded to 6 places, ties by id.
    An item is one row. The distinct words of the questions are gathered in the driver; items are written
    once with those of their words only, and each block of items keeps its own best ``k`` a query.
    """
    queries = queries.where(F.col("scope").isNotNull())
    vocabulary = sorted(r[0] for r in queries.select(F.explode(words_of(F.col("text"))).alias("word")).distinct().collect())
    packed = materialize(_packed(items.where(F.col("scope").isNotNull()), "item_id", vocabulary))
    size = packed.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    df = packed.select("scope", F.explode("terms").alias("term")).groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    asked = _packed(queries, "query_id", vocabulary).select("scope", "query_id", F.explode("terms").alias("term")).distinct()
    terms = asked.join(df, ["scope", "term"]).join(size, "scope")
    terms = terms.withColumn("idf", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    asked = terms.groupBy("scope", "query_id", "avg_len").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t")).select("scope", "query_id", "avg_len", "t.term", "t.idf").withColumnRenamed("term", "terms")
    some = packed.where(F.size("terms") > 0)
    return _ranked(_met(some, asked, size, packed.count(), _bm25_scores(len(vocabulary), k, k1, b)), k)


def _cosine_scores(k: int):
    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(items) or not len(queries):
            return _found(items, queries, [])
        items, units, begins = _ordered(items)
        asked = pc.fill_null(pc.index_in(queries["unit"], value_set=units), -1).to_numpy()
        (own, width), (wanted, length) = (((c := table["embedding"].combine_chunks()), pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)) for table in (items, queries))
        found = []
        for unit in np.unique(asked[asked >= 0]):
            rows, questions = np.arange(begins[unit], begins[unit + 1]), np.nonzero(asked == unit)[0]
            for size in np.unique(width[rows][width[rows] > 0]):
                r, q = rows[width[rows] == size], questions[length[questions] == size]
                data, vectors = (lists.take(pa.array(x)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), size) for lists, x in ((own, r), (wanted, q)))
                vectors, kind = np.unique(vectors, axis=0, return_inverse=True)  # questions of one vector are scored once
                q, kind = q[by := np.argsort(kind.ravel(), kind="stable")], kind.ravel()[by]
                step = max(1, SCORES // len(r))
                for a in range(0, len(vectors), step):
                    some = vectors[a : a + step]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        row, col, score = _top(np.nan_to_num(some @ data.T / np.sqrt((some * some).sum(1)[:, None] * (data * data).sum(1)[None, :])), k)
                    low, high = np.searchsorted(kind, [a, a + len(some)])
                    first, end = (np.searchsorted(row, kind[low:high] - a, side) for side in ("left", "right"))
                    each = np.repeat(first - np.cumsum(end - first) + (end - first), end - first) + np.arange((end - first).sum())
                    found.append((np.repeat(q[low:high], end - first), r[col[each]], score[each]))
        return _found(items, queries, found)

    return run


def scoped_topk(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` items of the highest cosine within each query's scope, ties by id: items (scope, item_id, embedding), queries (scope, query_id, embedding) to query_id, item_id, score, rank.

    Items are written once and read once whatever the number of queries, as both meet in blocks of a
    scope, and each block keeps its own best ``k`` a query. A query meets the items of its own vector
    length; a vector without a direction has a cosine of 0 with all; empty and NULL vectors rank nowhere.
    """
    there = F.col("scope").isNotNull() & (F.size("embedding") > 0)
    items = materialize(items.where(there).select("scope", "item_id", "embedding"))
    sizes = items.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    return _ranked(_met(items, queries.where(there).select("scope", "query_id", "embedding"), sizes, items.count(), _cosine_scores(k)), k)


def hybrid_topk(words: DataFrame, other: DataFrame, weight: float = 0.5, threshold: float = 0.0, k: int = 10) -> DataFrame:
    """Two rankings (query_id, item_id, score) fused: each scaled by its query's best, then weighted; scores under ``threshold`` go."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        top = F.max("score").over(W.partitionBy("query_id"))
        return df.select("query_id", "item_id", F.when(top > 0, F.col("score") / top).otherwise(0.0).alias(name))

    both = scaled(words, "a").join(scaled(other, "b"), ["query_id", "item_id"], "full_outer")
    score = F.round(weight * F.coalesce("a", F.lit(0.0)) + (1 - weight) * F.coalesce("b", F.lit(0.0)), 6)
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    fused = both.select("query_id", "item_id", score.alias("score")).where(F.col("score") >= threshold)
    return fused.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def result_id(index: Column, text: Column) -> Column:
    """``result-<index>-<first 8 of the hash>``: a result's id depends on its rank."""
    return F.concat(F.lit("result-"), index.cast("string"), F.lit("-"), F.substring(F.sha2(text, 256), 1, 8))


def source_numbers(rows: DataFrame, owner: str, pos: str, source: str) -> DataFrame:
    """``number``: sources of an owner numbered by first appearance."""
    first = F.min(pos).over(W.partitionBy(owner, source))
    return rows.withColumn("_first", first).withColumn("number", F.dense_rank().over(W.partitionBy(owner).orderBy("_first")).cast("bigint")).drop("_first")


def json_slice(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL without either."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
