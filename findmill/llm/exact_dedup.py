"""Exact dedup: distributed MSD radix partitioning of whole texts.

Texts are split by their bytes from the front: first into groups with the same first
``width`` bytes, then each group by the bytes that follow, and so on.  A group is done
when it is a singleton or its texts have ended, so equality is the equality of all bytes
read and no digest is compared.  Digits are blocks of bytes that widen by ``growth``, so
a text of n bytes takes log(n) rounds.

A round is one map-side combined aggregate and one join on (group, digit); a hot group is
counted per task before it moves, its join partition can be split, and no group is ever
collected.  The numbered rows are written before the first round, so that a task that runs
again after a lost executor finds the same numbers; after each round only texts that still
share a group are, without the bytes already read.

Defined results: a NULL text is an empty one.  Of equal texts the one with the most code
points in the original stays, then the smallest id; a NULL id is larger than any.  Rows
that repeat id and text are all listed, each a copy of the same ``keep`` id; the flag
``kept`` is true for one of them only.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from findmill.llm.tables import durable, forget

#: Bytes of the widest digit: a length is an INT.
WIDEST = 1 << 30
GROUP = ["__group", "__digit", "__ended"]


def normalised(text):
    """Text without any white space, as bytes."""
    return F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", ""), "utf-8")


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 48, growth: int = 96
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row of ``docs``."""
    numbered = durable(docs.select(
        F.col(doc_id).alias("__id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("__points"),
        normalised(F.col(text)).alias("__rest"),
        F.lit(0).cast("long").alias("__group"),
        F.monotonically_increasing_id().alias("__row"),
    ).withColumn("__sha", F.sha2("__rest", 256)), "radix-input")
    rows, done = numbered, []
    while True:
        rows = rows.withColumns({
            "__digit": F.substring("__rest", 1, width),
            "__ended": F.octet_length("__rest") <= width,
        })
        best = F.min_by(F.struct("__id", "__row"), F.struct(-F.col("__points"), F.col("__id").isNull(), "__id", "__row"))
        groups = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("__size"), best.alias("__best"))
        # the numbers of groups must not change when a task runs again: written first
        shared = durable(
            groups.where("__size > 1").withColumn("__next", F.monotonically_increasing_id()), "radix-groups"
        )
        over = F.col("__size").isNull() | F.col("__ended")
        split = durable(
            # always by key: whether the groups would fit a broadcast must not decide the plan
            rows.join(shared.hint("merge"), GROUP, "left").select(
                "__id", "__points", "__sha", "__row", F.col("__next").alias("__group"), "__size", "__best",
                F.when(~over, F.substring("__rest", width + 1, 2**31 - 1)).alias("__rest"),
            ),
            "radix-rows",
        )
        forget(shared, *([] if done else [numbered]))
        done.append(split.where("__rest IS NULL"))
        rows = split.where("__rest IS NOT NULL").select("__id", "__points", "__sha", "__row", "__group", "__rest")
        if rows.isEmpty():
            break
        width = min(width * growth, WIDEST)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(
        F.col("__id").alias("doc_id"),
        F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__best.__id")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__size").isNull() | (F.col("__best.__row") == F.col("__row"))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )
