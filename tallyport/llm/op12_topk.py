"""Exact top-k search by Fagin's threshold algorithm.

Vectors become integers, ``floor(256 * x)``, and the score is their inner product.  Candidates are dealt into blocks; each block
meets each batch of queries in a task of its own, in which the block holds one sorted list per dimension.  A query goes down
the lists together, from the large end where its component is positive and from the small end where it is negative, and
scores each vector that it meets for the first time against all dimensions.  Nothing unseen can score more than the query's
components times the values that the lists have reached; once that is less than the kth score the rest of the block is
left alone (at equality it is not, since a smaller id would win).  Depths grow by ``FACTOR`` a round.  When the lists would have
given as many entries as there are vectors, most are seen, and what is left is scored at once as a matrix product.

A batch has at most ``QUERIES`` queries and a block about ``BLOCK`` vectors, at any size of the table; a block gives k rows a
query, and Spark keeps the k best of them per query (before the shuffle, too).  Products are exact: doubles are used only
where every sum stays below 2**53, Python's integers where 64 bits may not do.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without id; vectors meet only those of
the same number of dimensions (empty ones score 0 among each other); an id stands for its row: rows that share one are never its
candidates, as a query the id counts once, with its smallest vector, and as candidates each row counts; components and scores beyond 64
bits count as the nearest long; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyport.llm import _session

NAME = "op12_topk"

TOP, EVERY, SCALE = 5, 50, 256
#: Queries of a batch at most, candidates of a block on average.
QUERIES, BLOCK = 2048, 8192
#: Entries of each list that the first round reads, and how much deeper each further round goes.
FIRST, FACTOR = 16, 4
_FOUND = "query_id long, vec_id long, score long, n_scored long"


def integers(vector: Column) -> Column:
    """``floor(256 * x)`` of each component, null for vectors that take no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * SCALE)))


def _exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact."""
    largest = [max(1, abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in (x, q)]
    bound = largest[0] * largest[1] * max(1, x.shape[1]) * 2
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    return x.astype(kind), q.astype(kind)


class Best:
    """The k highest scores so far, ties to smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, None, np.zeros(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= least
            scores, ids = scores[keep], ids[keep]
        if self.scores is not None:
            scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    def kth(self) -> float | int | None:
        return self.scores[-1] if len(self.ids) == self.k else None


def threshold_search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int = TOP) -> list[tuple[Best, int]]:
    """For each row of ``q`` its best rows of ``x`` whose id is another one, and how many rows were scored."""
    n, d = x.shape
    x, q = _exact(x, q)
    lists = np.argsort(x, axis=0, kind="stable") if n and d else np.zeros((n, d), dtype=np.int64)
    found, left = [], []
    for query, own in zip(q, q_ids, strict=True):
        best, seen = Best(k), ids == own
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        done, depth, over = 0, FIRST, False
        while not over and 0 < depth * (len(up) + len(down)) < n:
            met = np.concatenate((lists[n - depth : n - done][:, up].ravel(), lists[done:depth][:, down].ravel()))
            met = np.unique(met[~seen[met]])
            seen[met] = True
            best.add(x[met] @ query, ids[met])
            bound = x[lists[n - depth, up], up] @ query[up] + x[lists[depth - 1, down], down] @ query[down]
            over = best.kth() is not None and best.kth() > bound
            done, depth = depth, depth * FACTOR
        found.append((best, seen))
        left.append(not over)
    rest = np.flatnonzero(left)
    for at in range(0, len(rest), 256):
        some = rest[at : at + 256]
        for k_query, scores in zip(some, (x @ q[some].T).T, strict=True):
            best, seen = found[k_query]
            best.add(scores[~seen], ids[~seen])
            seen[:] = True
    return [(best, int(seen.sum())) for best, seen in found]


def _rows(table: pa.Table, id_column: str, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    vectors = table.column("ints").combine_chunks()
    flat = (vectors if isinstance(vectors, pa.Array) else pa.concat_arrays(vectors.chunks)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, dimensions).astype(np.int64), table.column(id_column).to_numpy()


def _meet(k: int):
    def run(key, queries: pa.Table, block: pa.Table) -> pa.Table:
        d = key[0].as_py()
        (q, q_ids), (x, ids) = _rows(queries, "query_id", d), _rows(block, "vec_id", d)
        out = threshold_search(x, ids, q, q_ids, k) if len(q) and len(x) else []
        sizes = [len(best.ids) for best, _ in out]
        clipped = [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for best, _ in out if len(best.ids) for s in best.scores]
        columns = [np.repeat(q_ids[: len(out)], sizes), np.concatenate([best.ids for best, _ in out]) if out else [], clipped, np.repeat([n for _, n in out], sizes)]
        return pa.table([pa.array(c, type=pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "n_scored"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best ``vectors (vec_id, ints)`` of each of ``queries (query_id, ints)``.

    ``n_scored`` is how many vectors were scored for the query in the block that holds the result.
    """
    taken = queries.groupBy("query_id").agg(F.min("ints").alias("ints"))
    n_queries, n_vectors = taken.count(), vectors.count()
    batches, blocks = -(-n_queries // QUERIES) or 1, -(-n_vectors // BLOCK) or 1
    row = F.monotonically_increasing_id()
    #: each side is dealt evenly (whatever ids repeat) and copied to the other side's groups
    left = taken.select("query_id", "ints", F.size("ints").alias("d"), F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int").alias("batch"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = vectors.select("vec_id", "ints", F.size("ints").alias("d"), F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int").alias("block"))
    right = right.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    keys = ("d", "batch", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_scored")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, by the contract of op12."""
    rows = _session.table(spark, sf_dir, "embeddings").select("vec_id", integers(F.col("embedding")).alias("ints")).filter("vec_id is not null and ints is not null")
    asked = rows.filter(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return search(rows, asked).drop("n_scored")


ORACLE_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
queries AS (SELECT vec_id AS query_id, min(ints) AS q FROM vectors WHERE vec_id % 50 = 0 GROUP BY vec_id),
scored AS (
  SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, ints), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM queries JOIN vectors ON len(q) = len(ints) AND query_id <> vec_id
),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""
