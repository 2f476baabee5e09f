"""Nearest neighbours by a hash-prefix forest.

Vectors are dealt over shards of about ``shard_rows`` rows by a hash of their id.  In each
shard every tree of the forest is a sorted array of ``bits``-bit hash strings (signs of
random projections around the shard's mean).  A query descends each tree to the longest
prefix it shares with a string there; then all trees ascend together, one bit at a time, and
the strings that share the shorter prefix become candidates, until there are ``share`` of
the shard (32 times ``k`` at least).  Candidates are measured exactly in double precision; each shard gives its best
``k``, and the best ``k`` over all shards are ranked.

All rows are indexed and nothing is fitted on a sample.  A shard's rows meet in one task and
their number is bounded by ``shard_rows`` on average; queries stream past the shards in
Arrow batches, so the stated query set is never held or broadcast.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components
take no part.  Vectors are compared with those of the same length only.  Rows with the
query's own id are not its neighbours; a query id given twice is answered for each row.  A
query without candidates has no result row.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

NEAR = "query_row long, query_id long, vec_id long, score double"
_SCHEMA = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Forest:
    """Sorted arrays of hash strings, one per tree, over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, trees: int, bits: int = 64, seed: int = 7):
        self.vectors, self.bits = vectors, bits
        self.center = vectors.mean(axis=0)
        # the same planes in every shard: they depend on the seed and the length only
        rng = np.random.default_rng([seed, vectors.shape[1]])
        self.planes = rng.standard_normal((trees, vectors.shape[1], bits))
        keys = self.keys(vectors)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=1)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings as big-endian integers: a row a tree."""
        out = np.empty((len(self.planes), len(vectors)), np.uint64)
        for t, plane in enumerate(self.planes):
            signs = np.zeros((len(vectors), 64), bool)
            signs[:, : self.bits] = (vectors - self.center) @ plane > 0
            out[t] = np.packbits(signs, axis=1).view(">u8")[:, 0]
        return out

    def _deepest(self, keys: np.ndarray) -> int:
        """The longest prefix that any tree shares with the query: it is that of a neighbour in the order."""
        best = 0
        for tree, key in zip(self.sorted, keys):
            at = int(np.searchsorted(tree, key))
            for k in (at - 1, at):
                if 0 <= k < len(tree):
                    best = max(best, 64 - int(tree[k] ^ key).bit_length())
        return min(best, self.bits)

    def candidates(self, keys: np.ndarray, wanted: int) -> np.ndarray:
        """Rows that share the longest prefixes, ``wanted`` of them at least if there are so many."""
        n = len(self.vectors)
        seen = np.zeros(n, bool)
        bounds: list[tuple[int, int] | None] = [None] * len(self.sorted)
        for length in range(self._deepest(keys), -1, -1):
            low_bits = np.uint64((1 << (64 - length)) - 1)
            for t, key in enumerate(keys):
                tree = self.sorted[t]
                low = int(np.searchsorted(tree, key & ~low_bits, "left"))
                high = int(np.searchsorted(tree, key | low_bits, "right"))
                if bounds[t] is None:
                    seen[self.order[t, low:high]] = True
                else:
                    was_low, was_high = bounds[t]
                    seen[self.order[t, low:was_low]] = True
                    seen[self.order[t, was_high:high]] = True
                bounds[t] = (low, high)
            if np.count_nonzero(seen) >= wanted:
                break
        return np.flatnonzero(seen)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not empty, all components finite, one not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def _search(k: int, trees: int, share: float):
    def matrix(batch: pa.Table | pa.RecordBatch) -> np.ndarray:
        column = batch.column("vec")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def answers(forest: Forest, ids: np.ndarray, missing: np.ndarray, asked: pa.RecordBatch) -> pa.RecordBatch | None:
        vectors = matrix(asked)
        keys = forest.keys(vectors)
        wanted = max(32 * k, int(np.ceil(share * len(ids)))) + 1
        rows: list[list[np.ndarray]] = []
        for i, (row, own) in enumerate(zip(asked.column("query_row").to_pylist(), asked.column("id").to_pylist())):
            found = forest.candidates(keys[:, i], wanted)
            found = found[missing[found] | (ids[found] != own)]
            distance = np.sqrt(((forest.vectors[found] - vectors[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[found], distance))[:k]
            n = len(best)
            rows.append([np.full(n, row), np.full(n, own), found[best], distance[best]])
        if not rows:
            return None
        row, own, found, distance = (np.concatenate(c) for c in zip(*rows))
        neighbour = pa.array(ids[found], pa.int64(), mask=missing[found])
        return pa.record_batch([pa.array(row), pa.array(own), neighbour, pa.array(distance)], schema=_SCHEMA)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stream sorted by shard, vectors before queries."""
        shard, held, forest, ids, missing = None, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = np.column_stack([batch.column(c).to_numpy() for c in ("dim", "shard")])
            asked = batch.column("query_row").is_valid().to_numpy(zero_copy_only=False)
            marks = np.column_stack([shards, asked])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                part, key = batch.slice(a, b - a), tuple(shards[a])
                if key != shard:
                    shard, held, forest = key, [], None
                if not asked[a]:
                    held.append(part)
                    continue
                if forest is None and held:
                    rows = pa.Table.from_batches(held)
                    number = rows.column("id").combine_chunks()
                    missing = number.is_null().to_numpy(zero_copy_only=False)
                    ids = number.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                    forest = Forest(matrix(rows), trees)
                    held = []
                if forest is not None:
                    out = answers(forest, ids, missing, part)
                    if out is not None:
                        yield out

    return search


def nearest(
    vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10,
    trees: int = 24, share: float = 0.65, shard_rows: int = 4096,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of each row where ``queries`` holds.

    Smallest Euclidean distance first, ties to the smaller id (a NULL id last).
    """
    rows = vectors.withColumn("__asked", F.coalesce(queries, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), "__asked"
    ).where(usable(F.col("vec"))).withColumn("dim", F.size("vec"))
    shards = {r.dim: -(-r.n // shard_rows) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = vectors.sparkSession
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])[F.col("dim")]
    index = rows.select(
        "dim", F.pmod(F.xxhash64("id", "vec"), count).cast("long").alias("shard"), "id", "vec",
        F.lit(None).cast("long").alias("query_row"),
    )
    asked = rows.where("__asked").withColumn("query_row", F.monotonically_increasing_id()).select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))).alias("shard"), "id", "vec", "query_row"
    )
    together = index.unionByName(asked).repartition(sum(shards.values()), "dim", "shard")
    together = together.sortWithinPartitions("dim", "shard", F.asc_nulls_first("query_row"))
    found = together.mapInArrow(_search(k, trees, share), NEAR)
    order = Window.partitionBy("query_row").orderBy("score", F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
