"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_bytes`` of text; a document belongs to the block
that it starts in, and a longer one takes the slots of the blocks it fills.  A source of weight w must
have its j-th block (from 1) in a window of slots: released at floor((j - 1) / w), due before
ceil(j / w).  Earliest deadline first over unit blocks meets all these windows, so at every
slot each source has had its share to less than one block.  With weights in whole parts of
``resolution`` the schedule repeats every ``resolution`` slots: one period is worked out on
the driver and the slot of any block follows by arithmetic.  Unless given, the resolution
follows the number of sources and of blocks, within bounds for the driver.

The mix ends when every source has been read once, so every document of a source with a
weight is in it.  Sources shorter than their weight asks are read again, up to ``max_epochs``
times; then they give up their slots, which stay empty, and the rest goes on.  A source of
less than a block or of a tiny weight has at least as many parts as put its first block
among the first slots, as many as there are blocks: it does not keep the others waiting.

Blocks need running totals of bytes.  They are summed by hash buckets of bounded size inside
a source, so no source, however hot, is sorted in one task.

Defined results: a NULL source is the source ''.  A NULL text has no bytes.  Rows that repeat
are mixed like any other.  An empty table or one without text gives blocks of one slot a
source.  Columns of the input are kept; results are added under the names asked for.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from findmill.llm.tables import packed, unpacked, unused


#: The driver holds every source and one period.  Sources at most:
MOST_SOURCES = 100_000
#: Bounds of a resolution that is not given: see resolution_for.
LEAST_PARTS, MOST_PARTS, PARTS_PER_SOURCE = 10_000, 100_000, 4


def resolution_for(sources: int, blocks: int) -> int:
    """A multiple of the number of blocks, or fewer parts than blocks where a period would get too large.

    Either way a source that is raised to ``resolution // blocks`` parts has its first slot among the first ``blocks``.
    """
    fine = max(LEAST_PARTS, PARTS_PER_SOURCE * sources)
    most = max(MOST_PARTS, fine)
    return most if blocks > most else blocks * -(-fine // blocks)


def parts_of(weights: dict[str, float], resolution: int, least: int = 1) -> dict[str, int]:
    """Weights as whole parts of ``resolution``, by largest remainder, ``least`` parts at least."""
    order = sorted((s for s, w in weights.items() if w > 0), key=lambda s: (weights[s], s))
    if len(order) * least > resolution:
        raise ValueError(f"{len(order)} sources need a resolution of {len(order) * least} parts at least")
    left = list(accumulate(weights[s] for s in reversed(order)))[::-1]
    exact, free = {}, float(resolution)
    # the lightest first: who is raised to ``least`` leaves less to the heavier ones
    for s, total in zip(order, left):
        exact[s] = max(float(least), weights[s] / total * free)
        free -= exact[s]
    parts = {s: max(least, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: resolution - sum(parts.values())]:
        parts[s] += 1
    return parts


def period(parts: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period: earliest deadline first."""
    length = sum(parts.values())
    releases = sorted(
        ((j * length) // a, -(-(j + 1) * length // a), source) for source, a in parts.items() for j in range(a)
    )
    slots: dict[str, list[int]] = {source: [] for source in parts}
    ready: list[tuple[int, str]] = []
    following = 0
    for slot in range(length):
        while following < len(releases) and releases[following][0] <= slot:
            heapq.heappush(ready, releases[following][1:])
            following += 1
        _, source = heapq.heappop(ready)
        slots[source].append(slot)
    return slots


def slot_of(slots: list[int], length: int, block: int) -> int:
    """The slot of a source's block (from 0) over all periods."""
    return block // len(slots) * length + slots[block % len(slots)]


def end_of(slots: dict[str, list[int]], blocks: dict[str, int]) -> int:
    """The number of slots of the mix: all that it takes to read every source once."""
    length = sum(map(len, slots.values()))
    return max(slot_of(slots[s], length, blocks[s] - 1) + 1 for s in blocks)


def with_blocks(
    docs: DataFrame, rows: dict[str, int], doc_id: str, text: str, source: str, block_bytes: int, bucket_rows: int
) -> DataFrame:
    """``(row, source, block)``: the packed rows of ``docs``, their source and the number of their block inside it.

    ``rows`` counts the rows of each source.
    """
    buckets = docs.sparkSession.createDataFrame([(s, -(-n // bucket_rows)) for s, n in rows.items()], "source string, buckets long")
    docs = packed(
        docs, source=F.coalesce(F.col(source), F.lit("")), place=F.xxhash64(doc_id, text),
        bytes=F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"),
    )
    docs = docs.join(F.broadcast(buckets), "source").withColumn("bucket", F.pmod("place", "buckets"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("source", "bucket").agg(F.sum("bytes").alias("sum"))
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    inside = Window.partitionBy("source", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.col("inside")
    return (
        docs.withColumn("inside", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
        .join(sums, ["source", "bucket"])
        .select("row", "source", F.floor(start / block_bytes).alias("block"))
    )


@dataclass
class Plan:
    """A schedule: the slots of one period by source, blocks and rows of each source, the slots of the mix and the reads of a source at most."""

    slots: dict[str, list[int]]
    blocks: dict[str, int]
    rows: dict[str, int]
    end: int
    max_epochs: int = 4

    def cuts(self, n: int) -> list[int]:
        """The first slots of ``n`` ranges, but that of the first one, with equally many slots that are not given up."""
        length = sum(map(len, self.slots.values()))
        given_up = sorted((self.max_epochs * self.blocks[s] * length / len(own), len(own)) for s, own in self.slots.items())
        at, filled, parts = [0.0], [0.0], length
        for slot, own in [*given_up, (self.end, 0)]:
            slot = min(slot, self.end)
            filled.append(filled[-1] + (slot - at[-1]) * parts / max(1, length))
            at.append(slot)
            parts -= own
        return [int(x) for x in np.interp([filled[-1] * k / n for k in range(1, n)], filled, at)]


def plan_mix(
    docs: DataFrame, weights: dict[str, float] | None = None, text: str = "text", source: str = "source",
    temper: float = 0.7, block_bytes: int = 1 << 16, max_epochs: int = 4, resolution: int | None = None,
) -> Plan:
    """The schedule of ``docs`` for ``weights`` by source; without them, each source's bytes to the power of ``temper``.

    Sources without a weight are not mixed.
    """
    found = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("s")).agg(
        F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")).alias("bytes"),
        F.count(F.lit(1)).alias("rows"),
    ).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r.s: r.bytes for r in found}
    given = weights or {s: max(1, b) ** temper for s, b in sizes.items()}
    given = {s: w for s, w in given.items() if s in sizes and w > 0}
    if not given:
        return Plan({}, {}, {}, 0)
    blocks = {s: max(1, -(-sizes[s] // block_bytes)) for s in given}
    total = sum(blocks.values())
    resolution = resolution or resolution_for(len(given), total)
    slots = period(parts_of(given, resolution, max(1, resolution // total)))
    return Plan(slots, blocks, {r.s: r.rows for r in found}, end_of(slots, blocks), max_epochs)


def mix(
    docs: DataFrame, plan: Plan, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    block_bytes: int = 1 << 16, max_epochs: int = 4, bucket_rows: int = 10_000,
    epoch: str = "epoch", block: str = "block", slot: str = "slot",
) -> DataFrame:
    """The documents of the mix with epoch, block inside the source and slot, in any order."""
    if not plan.slots:
        zero = F.lit(0).cast("long")
        return docs.withColumns({epoch: zero, block: zero, slot: zero}).where(F.lit(False))
    length = sum(map(len, plan.slots.values()))
    # one period: `resolution` rows
    turns = docs.sparkSession.createDataFrame(
        [(s, len(own), plan.blocks[s], r, at) for s, own in plan.slots.items() for r, at in enumerate(own)],
        "source string, parts long, blocks long, turn long, at long",
    )
    sources = turns.select("source", "parts", "blocks").distinct()
    placed = with_blocks(docs, plan.rows, doc_id, text, source, block_bytes, bucket_rows)
    placed = placed.join(F.broadcast(sources), "source").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_epochs - 1).cast("long")))
    )
    # empty texts after the last full block belong to it
    placed = placed.withColumn("block", F.least("block", F.col("blocks") - 1))
    turn = F.col("epoch") * F.col("blocks") + F.col("block")
    placed = placed.withColumns({"turn": turn % F.col("parts"), "round": F.floor(turn / F.col("parts"))})
    placed = placed.join(F.broadcast(turns.select("source", "turn", "at")), ["source", "turn"])
    at = F.col("round") * length + F.col("at")
    return unpacked(
        placed.where(at < plan.end), docs.columns, **{epoch: F.col("epoch"), block: F.col("block"), slot: at}
    )


def in_order(
    mixed: DataFrame, end: int, slot: str = "slot", partitions: int | None = None, plan: Plan | None = None
) -> DataFrame:
    """The mix in the order of its slots, over as many partitions as the session shuffles to.

    ``end`` is the number of slots.  Equal ranges of slots are equal shares of the mix and nothing is sampled;
    with the ``plan``, ranges are equal in slots that are not given up.
    """
    n = partitions or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(plan.cuts(n) if plan else [end * k // n for k in range(1, n)]) - {0})
    if not cuts:
        return mixed.repartitionById(n, F.lit(0)).sortWithinPartitions(slot)
    at, place = unused(mixed, "at"), unused(mixed, "place")
    dealt = Bucketizer(splits=[-math.inf, *map(float, cuts), math.inf], inputCol=at, outputCol=place)
    dealt = dealt.transform(mixed.withColumn(at, F.col(slot).cast("double")))
    return dealt.repartitionById(n, F.col(place).cast("int")).drop(at, place).sortWithinPartitions(slot)
