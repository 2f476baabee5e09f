"""Corpus pipeline: documents in, token ids of a clean, mixed corpus out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet
and read again as the next stage's ``docs``.  All stages but the last return the columns of
``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findmill.llm import byte_bpe, line_dedup, mixing, ngram_join, toxicity
from findmill.llm.tables import durable, settled, table, unused
from findmill.session import prepare

#: The stages learn from labels and use hashed sets, so no SQL gives the same rows; tests compare
#: them with brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.5 or more."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(docs.select("doc_id", "text").join(labels.hint("merge"), "doc_id"), "text", "toxic", "doc_id")
    score = unused(docs, "score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters in at least 5 documents stay in one of them only."""
    prepare(spark)
    kept, lines, dropped = (unused(docs, n) for n in ("kept", "lines", "dropped"))
    left = line_dedup.dedup_lines(docs, kept=kept, n_lines=lines, n_dropped=dropped)
    names = {"text": F.col(kept)} | ({"n_chars": F.char_length(kept).cast("long")} if "n_chars" in docs.columns else {})
    # documents that lost nothing stay as they are, a NULL text included
    return left.select(*[
        F.when(F.col(dropped) > 0, names[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in docs.columns
    ])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8 or more.

    Rows are judged by their texts: each distinct text stands for the rows that have it, and of a group the
    row of the smallest (id, hash of the text) stays.  Rows that are equal in both stay once.  Unlike texts
    under one id all stay, and so do rows without an id.
    """
    prepare(spark)
    row, place = unused(docs, "row"), unused(docs, "place")
    key = F.struct("doc_id", F.sha2("text", 256))
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    numbered = durable(docs.withColumn(row, number), "near-copies-rows")
    groups = settled(ngram_join.similar_documents(numbered, doc_id=row), "near-copies")
    groups = groups.select(F.col("doc_id").alias(row), "component_id", "n_shingles").where("n_shingles > 0")
    # only rows that share their group can go
    several = groups.groupBy("component_id").count().where("count > 1").select("component_id")
    shared = numbered.select(row, key.alias(place)).join(groups.join(several, "component_id").hint("merge"), row)
    first = settled(shared.groupBy("component_id").agg(F.min(F.struct(place, row)).alias("first")), "near-copies-first")
    copies = shared.select(row).join(first.select(F.col(f"first.{row}").alias(row)), row, "left_anti")
    return numbered.join(copies, row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order; documents of small sources come once an epoch, so no document is lost to the weights."""
    prepare(spark)
    plan = mixing.plan_mix(docs)
    epoch, block, slot = (unused(docs, n) for n in ("epoch", "block", "slot"))
    return mixing.in_order(mixing.mix(docs, plan, epoch=epoch, block=block, slot=slot), plan.end, slot, plan=plan).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    prepare(spark)
    decoded = byte_bpe.round_trip(docs.select("doc_id", "source", "text"))
    return decoded.select(
        "doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
