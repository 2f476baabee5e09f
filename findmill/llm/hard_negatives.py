"""Hard negatives for contrastive training, by a secondary-sort shuffle.

Rows are vectors with a label; each component x counts as ``floor(scale * x)``, and a row's score
for an anchor is the integer inner product.  An anchor's positives are its best other rows of its
label.  Each positive opens a window of scores (``low`` to ``high`` percent of its own), and the
best rows of other labels in the window are its hard negatives.

1. Rows are dealt over shards by a hash of their id.  The anchors stream past each shard in Arrow
   batches, so they are never held or broadcast; a shard hands over each anchor's best positives.
2. A score is packed into one binary key (anchor, descending score, role, id).  The keys are
   repartitioned by anchor and sorted inside the partitions, the DataFrame form of
   repartitionAndSortWithinPartitions: the shuffle sorts and spills, and a streaming iterator keeps
   the first of each anchor.
3. With the windows known, the anchors stream past the shards again; a shard hands over only the
   rows that can be among the first of a window.
4. Positives and candidates meet in a second shuffle of the same keys.  The iterator opens a window
   at each positive and emits negatives as they pass; it holds the open windows of one anchor and
   nothing else.  Positives come before rows of the same score, as a window may hold its own score.

Every row meets every anchor, so the work is rows times anchors; the shuffles carry vectors once,
anchors once a shard, and of the scores only what each shard may contribute.

Defined results: rows with a NULL id, label or vector, or a NULL or non-finite component take no
part, nor do rows whose scores could leave the range of a long.  Vectors are compared with those of
the same length only (empty ones too: they score 0).  Of rows that repeat an id, the one of the
smallest (label, vector) counts.  Ties go to the smaller id.  Anchors without a positive, and
positives without a negative in their window, have no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from findmill.llm.tables import durable, forget

#: Bytes of vectors that one shard holds, on average, and rows of the smallest shards made for the sake of more tasks.
SHARD_BYTES, SHARD_ROWS = 64 << 20, 2048
#: Scores worked out at a time.
BLOCK = 1 << 21
POSITIVE, NEGATIVE = 0, 1

_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("role", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)


def pack_keys(anchor: np.ndarray, score: np.ndarray, role: int, ids: np.ndarray) -> pa.Array:
    """Binary keys that sort by anchor, descending score, role and id."""
    keys = np.empty(len(ids), _KEY)
    keys["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ _SIGN
    keys["score"] = ~(score.astype(np.int64).view(np.uint64) ^ _SIGN)
    keys["role"] = role
    keys["id"] = ids.astype(np.int64).view(np.uint64) ^ _SIGN
    ends = np.arange(len(ids) + 1, dtype=np.int32) * _KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(keys.tobytes())])


def unpack_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, scores, roles and ids of packed keys."""
    keys = np.frombuffer(b"".join(column.to_pylist()), _KEY)
    plain = lambda x: (x.astype(np.uint64) ^ _SIGN).view(np.int64)
    return plain(keys["anchor"]), plain(~keys["score"].astype(np.uint64)), keys["role"], plain(keys["id"])


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score of a positive's negatives: ``low * positive <= 100 * score <= high * positive``."""
    return -(-low * positive // 100), high * positive // 100


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two matrices of whole numbers."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def first_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores, ties to the smaller place, in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    last = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > last)
    return np.concatenate((above, np.flatnonzero(scores == last)[: k - len(above)]))


def _by_length(batch: pa.RecordBatch | pa.Table, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and scaled vectors for each length of vector."""
    column = batch.column("vec")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, np.floor(scale * flat.astype(np.float64)).reshape(len(rows), d)


class Shard:
    """Ids, labels and vectors of a shard's rows by length of vector, ascending by id."""

    def __init__(self, rows: pa.Table, scale: int):
        rows = rows.sort_by("id")
        ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
        self.parts = {v.shape[1]: (ids[at], labels[at], v) for at, v in _by_length(rows, scale)}


def _positives(shard: Shard, anchors: pa.RecordBatch, scale: int, k: int) -> Iterator[pa.Array]:
    ids, labels = (anchors.column(c).to_numpy() for c in ("id", "label"))
    for at, vectors in _by_length(anchors, scale):
        if vectors.shape[1] not in shard.parts:
            continue
        row_ids, row_labels, rows = shard.parts[vectors.shape[1]]
        for label in np.unique(labels[at]):
            same = np.flatnonzero(row_labels == label)
            asked = np.flatnonzero(labels[at] == label)
            if not len(same):
                continue
            step = max(1, BLOCK // len(same))
            for cut in range(0, len(asked), step):
                part = asked[cut : cut + step]
                for i, scores in zip(part, inner_products(vectors[part], rows[same])):
                    others = np.flatnonzero(row_ids[same] != ids[at[i]])
                    best = others[first_rows(scores[others], k)]
                    yield pack_keys(np.full(len(best), ids[at[i]]), scores[best], POSITIVE, row_ids[same[best]])


def _candidates(shard: Shard, anchors: pa.RecordBatch, scale: int, k: int, low: int, high: int) -> Iterator[pa.Array]:
    ids, labels, found = anchors.column("id").to_numpy(), anchors.column("label").to_numpy(), anchors.column("found").to_pylist()
    for at, vectors in _by_length(anchors, scale):
        if vectors.shape[1] not in shard.parts:
            continue
        row_ids, row_labels, rows = shard.parts[vectors.shape[1]]
        step = max(1, BLOCK // max(1, len(rows)))
        for cut in range(0, len(at), step):
            part = np.arange(cut, min(cut + step, len(at)))
            for i, scores in zip(part, inner_products(vectors[part], rows)):
                windows = {window_of(p, low, high) for p in found[at[i]]}
                windows = [w for w in windows if w[0] <= w[1]]
                if not windows:
                    continue
                reach = (scores >= min(w[0] for w in windows)) & (scores <= max(w[1] for w in windows))
                near = np.flatnonzero(reach & (row_labels != labels[at[i]]))
                chosen = []
                for least, most in windows:
                    inside = near[(scores[near] >= least) & (scores[near] <= most)]
                    chosen.append(inside[first_rows(scores[inside], k)])
                best = np.unique(np.concatenate(chosen))
                yield pack_keys(np.full(len(best), ids[at[i]]), scores[best], NEGATIVE, row_ids[best])


def _past_shards(answer, scale: int):
    """``answer(shard, anchors)`` for each batch of anchors, of a stream sorted by shard, rows before anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("shard").to_numpy()
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (asked[1:] != asked[:-1])) + 1), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if numbers[a] != number:
                    number, held, shard = numbers[a], [], None
                if not asked[a]:
                    held.append(part)
                    continue
                if shard is None and held:
                    shard, held = Shard(pa.Table.from_batches(held), scale), []
                if shard is not None:
                    keys = [k for k in answer(shard, part) if len(k)]
                    if keys:
                        yield pa.record_batch([pa.concat_arrays(keys)], names=["key"])

    return work


def _sorted_keys(keys: DataFrame) -> DataFrame:
    """The secondary sort: one partition has all keys of an anchor, in order."""
    return keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")


def _first_of_anchor(k: int):
    """The first ``k`` keys of each anchor of a sorted stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, taken = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors, scores, _, ids = unpack_keys(batch.column("key"))
            kept = []
            for i, a in enumerate(anchors.tolist()):
                if a != anchor:
                    anchor, taken = a, 0
                if taken < k:
                    taken += 1
                    kept.append(i)
            yield pa.record_batch(
                [batch.column("key").take(pa.array(kept, pa.int64())), pa.array(anchors[kept]), pa.array(ids[kept]), pa.array(scores[kept])],
                names=["key", "anchor_id", "positive_id", "positive_score"],
            )

    return work


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _open_windows(k: int, low: int, high: int):
    """Negatives of each positive, of a sorted stream: windows open at positives and close when full or passed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for a, score, role, row in zip(*(c.tolist() for c in unpack_keys(batch.column("key")))):
                if a != anchor:
                    anchor, windows = a, []
                if role == POSITIVE:
                    windows.append([row, score, *window_of(score, low, high), 0])
                    continue
                passed = False
                for w in windows:
                    if w[2] <= score <= w[3]:
                        w[4] += 1
                        out.append((a, w[0], w[4], row, w[1], score))
                    passed |= w[4] == k or score < w[2]
                if passed:
                    windows = [w for w in windows if w[4] < k and score >= w[2]]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[
                    "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return work


def _usable(rows: DataFrame, scale: int) -> DataFrame:
    """Rows that take part, one of each id."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale + 1 <= F.sqrt(F.lit(2.0**62) / F.greatest(F.size("vec"), F.lit(1))))
    whole = F.forall("vec", lambda x: F.coalesce(fits(x), F.lit(False)))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").where(whole)
    one = Window.partitionBy("id").orderBy("label", "vec")
    return rows.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")


def mine_negatives(
    rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of the rows where ``anchors`` holds."""
    spark = rows.sparkSession
    named = F.col(label) if isinstance(label, str) else label
    taking = rows.select(
        F.col(vec_id).cast("long").alias("id"), named.cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    taking = durable(_usable(taking, scale), "negatives-rows")
    n, held = taking.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * F.size("vec") + 16), F.lit(0))).first()
    shards = max(-(-held // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, -(-n // SHARD_ROWS)), 1)

    found_type = F.lit(None).cast("array<long>")
    index = taking.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.lit(False).alias("asked"), "id", "label", "vec", found_type.alias("found"))

    def past(asked: DataFrame, answer) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
        together = index.unionByName(asked.select(every, F.lit(True).alias("asked"), "id", "label", "vec", "found"))
        together = together.repartition(shards, "shard").sortWithinPartitions("shard", "asked")
        return together.mapInArrow(_past_shards(answer, scale), "key binary")

    asked = taking.where("anchor").select("id", "label", "vec", found_type.alias("found"))
    best = past(asked, lambda shard, batch: _positives(shard, batch, scale, positives))
    best = _sorted_keys(best).mapInArrow(_first_of_anchor(positives), "key binary, anchor_id long, positive_id long, positive_score long")
    best = durable(best, "negatives-positives")
    windows = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("positive_score").alias("found"))
    asked = asked.drop("found").join(windows, "id")
    near = past(asked, lambda shard, batch: _candidates(shard, batch, scale, negatives, low, high))
    mined = durable(_sorted_keys(best.select("key").unionByName(near)).mapInArrow(_open_windows(negatives, low, high), MINED), "negatives")
    forget(taking, best)
    return mined
