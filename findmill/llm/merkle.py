"""Merkle manifest of a table: one tree a group, one tree over the groups, proofs for every row.

A leaf is the hash of a row's fields, a node the hash of ``FAN`` consecutive nodes below it (the last
run of a level may be shorter, even one); every hash is lowercase hex SHA-256 of its inputs' texts one
after the other.  Leaves ascend by key inside their tree; the groups' roots ascend by group (NULL
first, else by UTF-8 bytes) and are hashed up to the root in the same way.

Checkpoint and recompute: of all levels only every ``EVERY``-th is written.  The nodes between two
written levels belong to aligned subtrees of ``FAN ** EVERY`` nodes at most, so one task can work them
out anew from the written nodes below; nobody keeps them.

* Building groups the nodes of a written level by aligned subtree and writes the subtrees' tops.
* Proofs go down: a written node's way to the root (its siblings, left and right, level by level) is
  one row sent to the subtree below it.  There the missing levels are regenerated, each lower node's
  siblings are put in front of that way, and the regenerated nodes are dropped.  So a way is shuffled
  once for each subtree, not once for each row.

Positions come from ranges of (group, key, leaf), so a group with most of the rows spreads over many
tasks; a subtree is the largest unit of work.

Defined results: NULL fields are ``-``, so NULL and empty differ.  A NULL key sorts first.  Rows that
repeat a key are ordered by their leaf; wholly equal rows are leaves of their own with equal digests.
A group of one row has its leaf as its root, one group alone has its root as the root of all; an empty
table has no root and no proofs.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from findmill.llm.ranks import ranked
from findmill.llm.tables import durable, grouped_runs

FAN, EVERY = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WAY = "array<struct<left:string,right:string>>"
#: The roots that a way ends at.
SEALS = ["subroot", "root"]


def hashed(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The hash of a row: each field as its UTF-8 bytes' count, a colon and its value, or ``-`` for NULL."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def depth(nodes: int) -> int:
    """Levels above ``nodes`` nodes until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def regenerate(digests: list[str], levels: int) -> list[list[str]]:
    """The given nodes of an aligned subtree and the levels above them."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([hashed(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def siblings(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each lowest node its siblings to the left and to the right, level by level."""
    steps = []
    for level in levels[:-1]:
        beside = []
        for i in range(len(level)):
            first = i - i % FAN
            beside.append(("".join(level[first:i]), "".join(level[i + 1 : first + FAN])))
        steps.append(beside)
    return [[beside[i // FAN**k] for k, beside in enumerate(steps)] for i in range(len(levels[0]))]


def climbed(digest: Column, way: Column) -> Column:
    """The root that a leaf and its way lead to."""
    return F.aggregate(way, digest, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def siblings_hash(way: Column) -> Column:
    """The hash of all siblings of a way."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), ""), 256)


@dataclass
class Manifest:
    """The written levels of all trees, lowest first (tree, pos, n, digest), and those of the tree over them."""

    levels: list[DataFrame]
    top: list[DataFrame]
    carried: list[str]


def _up(nodes: DataFrame) -> DataFrame:
    """The tops of the aligned subtrees of a written level."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, subtree, n = (group.column(c)[0].as_py() for c in ("tree", "subtree", "n"))
        levels = min(EVERY, depth(n))
        top = regenerate(group.column("digest").to_pylist(), levels)[-1]
        yield pa.record_batch([[tree], [subtree], [-(-n // FAN**levels)], top], schema=schema)

    cut = nodes.where("n > 1").select("tree", F.expr(f"pos div {FAN**EVERY}").alias("subtree"), "pos", "n", "digest")
    cut = cut.repartition("tree", "subtree").sortWithinPartitions("tree", "subtree", "pos")
    return cut.mapInArrow(lambda batches: grouped_runs(batches, ["tree", "subtree"], work), "tree string, pos long, n long, digest string")


def _build(leaves: DataFrame, name: str) -> list[DataFrame]:
    levels = [leaves]
    while not levels[-1].where("n > 1").isEmpty():
        levels.append(durable(_up(levels[-1]), name))
    return levels


def build_manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, **carried: Column) -> Manifest:
    """Hash every row and build the trees; ``carried`` columns stay with the leaves."""
    # '-' for NULL sorts before the '=' of all others
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = rows.select(
        tree.alias("tree"), F.col(key).alias("key"), leaf_of(*[F.col(f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in carried.items()]
    )
    leaves = durable(leaves, "merkle-rows")
    levels = _build(durable(ranked(leaves, ["tree"], ["key", "digest"], "merkle-ranks", "pos", "n"), "merkle-leaves"), "merkle-level")
    roots = None
    for level in levels:
        one = level.where("n = 1").select("tree", "digest")
        roots = one if roots is None else roots.unionByName(one)
    over = roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    top = _build(durable(ranked(over, ["tree"], ["group"], "merkle-ranks", "pos", "n"), "merkle-groups"), "merkle-top")
    return Manifest(levels, top, list(carried))


def _down(nodes: DataFrame, ways: DataFrame, kept: list[str]) -> DataFrame:
    """The way to the root of every node, given those of the written nodes above (tree, pos, way, subroot, root)."""
    step = pa.struct([("left", pa.string()), ("right", pa.string())])

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        above = [(s["left"], s["right"]) for s in group.column("way")[0].as_py()]
        sealed = [group.column(c)[0].as_py() for c in SEALS]
        group = group.slice(1)
        levels = regenerate(group.column("digest").to_pylist(), min(EVERY, depth(group.column("n")[0].as_py())))
        found = [own + above for own in siblings(levels)]
        left, right = ([s[k] for way in found for s in way] for k in (0, 1))
        flat = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(step))
        ends = pa.array(range(0, len(left) + 1, max(1, len(found[0]))) if left else [0] * (len(found) + 1), pa.int32())
        ways = pa.ListArray.from_arrays(ends, flat)
        batch = group.select(["tree", "pos", *kept]).combine_chunks().to_batches()[0]
        # small batches: ways are long
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            seals = [pa.repeat(pa.scalar(s, pa.string()), part.num_rows) for s in sealed]
            yield pa.record_batch([*part.columns, ways.slice(start, 128), *seals], names=["tree", "pos", *kept, "way", *SEALS])

    types = dict(nodes.dtypes)
    below = nodes.select("tree", F.expr(f"pos div {FAN**EVERY}").alias("subtree"), "pos", "n", "digest", *[c for c in kept if c != "digest"])
    # a subtree's way comes before its nodes
    above = ways.select("tree", F.col("pos").alias("subtree"), F.lit(-1).cast("long").alias("pos"), "way", *SEALS)
    together = below.unionByName(above, allowMissingColumns=True)
    together = together.repartition("tree", "subtree").sortWithinPartitions("tree", "subtree", "pos")
    schema = ", ".join(["tree string", "pos long", *(f"`{c}` {types[c]}" for c in kept), f"way {WAY}", *(f"{c} string" for c in SEALS)])
    return together.mapInArrow(lambda batches: grouped_runs(batches, ["tree", "subtree"], work), schema)


def _ways(levels: list[DataFrame], entry: DataFrame, kept: list[str]) -> DataFrame:
    """The way of every lowest node; ``entry`` has that of each tree's root (tree, way, subroot, root)."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        columns = ["digest", *kept] if k == 0 else []
        nodes = levels[k]
        ends = nodes.where("n = 1").select("tree", "pos", *columns).join(entry, "tree")
        if above is not None:
            ends = ends.unionByName(_down(nodes.where("n > 1"), above, columns))
        above = ends if k == 0 else durable(ends, "merkle-ways")
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """``(tree, pos, digest, key, <carried>, way, subroot, root)`` of every row: its leaf, the siblings up to the root, both roots."""
    start = manifest.top[-1].select(
        "tree", F.array().cast(WAY).alias("way"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")
    )
    groups = _ways(manifest.top, start, ["group"])
    entry = durable(groups.select(F.col("group").alias("tree"), "way", F.col("digest").alias("subroot"), "root"), "merkle-entries")
    return _ways(manifest.levels, entry, ["key", *manifest.carried])
