"""Exact top-k search by inner product: the threshold algorithm over sorted per-dimension lists.

Vectors are dealt over shards of about ``shard_rows`` rows. A shard sorts its rows once in each dimension. For a
query, all lists are read downwards together, best contribution first, in steps of growing length; rows met for the
first time get their whole score. The bound is what a row not yet met can reach at most: the sum of the
contributions at the depth reached. A query stops when its bound is below its kth score, so that a row of equal
score and smaller id is never missed. The first shard is searched before the others: its kth score is a floor for them, which
lets their lists end where nothing above it can follow. The best of each shard are then merged.

Queries are dealt in blocks of ``query_rows``; each pair of shard and block is one bounded task. The number of such
pairs grows as rows times queries, which is what the contract asks for.

Edge cases: rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part;
vectors are compared with those of the same length only; rows that share a query's id count as its own; repeated
rows (same id and vector) count once, the same vector under other ids is a candidate of its own; empty vectors score 0 with each other.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendspan.llm.common import only, table, written

SHARD_ROWS, QUERY_ROWS = 2048, 1024


def threshold_search(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, query_id: int, k: int, down: np.ndarray, floor: int | None = None, first: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows, but for those below the floor. ``down``: for each dimension, row numbers by falling component."""
    n, dims = rows.shape
    open_ = ids != query_id
    met = np.zeros(n, dtype=bool)
    best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    used = np.flatnonzero(query)
    up = query[used] < 0
    depth, step = 0, first
    while depth < n:
        end = min(n, depth + step)
        if len(used):
            ahead = down[used[~up], depth:end].ravel()
            behind = down[used[up]][:, n - end : n - depth].ravel()
            here = np.zeros(n, dtype=bool)
            here[ahead] = True
            here[behind] = True
            here &= ~met
        else:  # every row scores 0
            here, end = ~met, n
        met |= here
        new = np.flatnonzero(here & open_)
        best_ids, best = np.concatenate([best_ids, ids[new]]), np.concatenate([best, rows[new] @ query])
        if len(best) > k:
            keep = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[keep], best[keep]
        depth, step = end, step * 2
        if depth < n and (len(best) == k or floor is not None):
            at = np.where(up, down[used, n - depth], down[used, depth - 1])
            least = max(x for x in (floor, best.min() if len(best) == k else None) if x is not None)
            if int((rows[at, used] * query[used]).sum()) < least:
                break
    return (best_ids, best) if floor is None else (best_ids[best >= floor], best[best >= floor])


def _search(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(rows) and len(queries):
        ids, x = rows["vec_id"].to_numpy(np.int64), np.stack(rows["scaled"].to_numpy()).astype(np.int64)
        down = np.argsort(-x, axis=0, kind="stable").T.copy()
        floors = queries["floor"] if "floor" in queries else [None] * len(queries)
        for query_id, q, floor in zip(queries["vec_id"].to_numpy(np.int64), queries["scaled"], floors, strict=True):
            found, score = threshold_search(ids, x, np.asarray(q, dtype=np.int64), query_id, k, down, None if pd.isna(floor) else int(floor))
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": found, "score": score}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, embedding); ``is_query`` is a condition on vec_id."""
    usable = only(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    usable = usable.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    scaled = usable.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("scaled")).withColumn("dims", F.size("scaled"))
    rows = written(scaled.dropDuplicates(["vec_id", "scaled"]))
    queries = rows.filter(is_query)
    n, n_queries = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_rows))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    dealt = rows.withColumn("shard", deal("vec_id", shards))
    asked = queries.withColumn("block", deal("vec_id", blocks))
    key = ("dims", "shard", "block")

    def searched(some: DataFrame, queries: DataFrame) -> DataFrame:
        left = some.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return left.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(lambda a, b: _search(a, b, k), "query_id long, vec_id long, score long")

    head = written(searched(dealt.filter("shard = 0"), asked.withColumn("shard", F.lit(0))))
    # the kth score; rows of a query that share its id with other vectors are queries of their own, and the lowest floor holds for all
    floors = head.dropDuplicates().groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("query_id").alias("vec_id"), F.get("s", F.lit(k - 1)).alias("floor"))
    once = asked.groupBy("vec_id").agg(F.count("*").alias("same"))
    asked = written(asked.join(floors, "vec_id", "left").join(once, "vec_id").withColumn("floor", F.when(F.col("same") == 1, F.col("floor"))).drop("same"))
    rest = searched(dealt.filter("shard > 0"), asked.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))) if shards > 1 else head.limit(0)
    found = head.unionByName(rest).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
