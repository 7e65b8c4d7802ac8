"""Exact top-k search by term-at-a-time accumulation (operator 3).

Vectors are quantised to integers; a dimension is a term, and the nonzero
weights of a block of candidates in it are its postings. Queries and
candidates are dealt into hash blocks; each pair of a query block and a
candidate block is one group (the stated query set against all rows, in
blocks of bounded size). A group's task takes the terms one after another
and adds weight x postings into a dense score array (queries x candidates),
then partitions each row of scores for its ``k`` best. The partial lists are
merged by rank. Every query meets every candidate, so the result is exact.

Defined cases: vectors that are null, empty, or hold a null, NaN or infinite
component take no part; a vector of fewer terms counts as 0 in the missing
ones. Every row is an item of its own, rows that repeat an id included: each
query row gets its own list, in which the other rows of its id may stand. Rows
with a null id are no items. Ties go to the smaller id. A query with fewer than
``k`` other items gets all. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.llm.textops import stored

CANDIDATE_BLOCK = 16384
QUERY_BLOCK = 2048
ROWS = 128  # query rows whose dense scores are held at once
SCHEMA = "query long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """A number that names the row, vec_id and the integer weights, of the vectors that take part."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    w = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    items = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), w.alias("w"))
    return items.select(F.monotonically_increasing_id().alias("item"), "vec_id", "w")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of weights, zero where a row is shorter."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(a.value_lengths(), np.int64)
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(a), int(lengths.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(a)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def best(item: np.ndarray, q: np.ndarray, c_item: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query row its k best of these candidates, itself left out: (query rows by place, candidate ids, scores)."""
    order = np.argsort(cid, kind="stable")
    cid, c, c_item = cid[order], c[order], c_item[order]
    place = np.argsort(c_item)  # candidates in the order of their row numbers, to find a query's own row
    terms = min(q.shape[1], c.shape[1])
    bound = terms * int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0))
    if bound >= 1 << 62:
        raise OverflowError("scores exceed 64 bits")
    kind = np.int32 if bound < 1 << 31 else np.int64
    # postings of a term: candidate places and weights, or for a term that most have, a weight for every place
    postings = []
    for t in range(terms):
        at = np.flatnonzero(c[:, t])
        common = 2 * len(at) > len(cid)
        postings.append((None, c[:, t].astype(kind)) if common else (at, c[at, t].astype(kind)))
    n, out = len(cid), ([], [], [])
    for lo in range(0, len(item), ROWS):
        rows = q[lo : lo + ROWS]
        scores = np.zeros((len(rows), n), kind)
        for i, weights in enumerate(rows):
            line = scores[i]
            for t in np.flatnonzero(weights[:terms]):
                at, value = postings[t]
                if at is None:
                    line += kind(weights[t]) * value
                else:
                    line[at] += kind(weights[t]) * value
        # a single key orders by score, then smaller id: candidates are in the order of their ids
        if bound < (1 << 62) // max(n, 1):
            key = scores.astype(np.int64) * n - np.arange(n)
        else:  # too large for one key: its rank is the key
            key = np.empty(scores.shape, np.int64)
            for i, line in enumerate(scores):
                key[i, np.lexsort((-np.arange(n), line))] = np.arange(n)
        own = place[np.minimum(np.searchsorted(c_item, item[lo : lo + ROWS], sorter=place), n - 1)]
        here = np.flatnonzero(c_item[own] == item[lo : lo + ROWS])
        key[here, own[here]] = np.iinfo(np.int64).min
        take = min(k + 1, n)
        top = np.argpartition(key, n - take, axis=1)[:, n - take :]
        top_keys = np.take_along_axis(key, top, axis=1)
        rank = np.argsort(-top_keys, axis=1, kind="stable")[:, :k] if take else top
        top = np.take_along_axis(top, rank, axis=1)
        real = np.take_along_axis(key, top, axis=1) != np.iinfo(np.int64).min
        r, _ = np.nonzero(real)
        out[0].append(lo + r)
        out[1].append(cid[top[real]])
        out[2].append(np.take_along_axis(scores, top, axis=1)[real].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 64.0, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``is_query`` (a condition on vec_id) holds,
    its k highest integer inner products with all other rows."""
    items = stored(quantised(vectors, id_col, vector_col, scale))
    n = items.count()
    n_queries = items.where(is_query).count()
    n_c, n_q = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_queries / query_block))
    candidates = items.select("item", "vec_id", "w", F.pmod(F.xxhash64("item"), F.lit(n_c)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    queries = items.where(is_query).select("item", "vec_id", "w", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"), F.pmod(F.xxhash64("item"), F.lit(n_q)).alias("qb"))

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            at, vec_id, score = best(left["item"].to_numpy(), _matrix(left["w"]), right["item"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right["w"]), k)
        else:
            at = vec_id = score = np.zeros(0, np.int64)
        return pa.table({"query": left["item"].to_numpy()[at], "query_id": left["vec_id"].to_numpy()[at], "vec_id": vec_id, "score": score})

    key = [F.col("cb").cast("long"), F.col("qb").cast("long")]
    partial = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(scores, SCHEMA)
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = partial.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
