"""Line dedup across documents: levelled sorted runs of line hashes.

A run is a table of line keys sorted by key: ``(h1, h2, docs, keeper)``, the key's
128-bit hash, the number of documents that hold it and the document that keeps it.
Documents come in batches, the largest ids first.  Each batch is joined against the
runs by a sort-merge anti-join: keys not seen before get the batch's largest id as
their keeper, and the batch becomes a run of its own.  Runs are compacted level by
level, ``fanout`` runs into one of the next level, so a key is rewritten once a level.

DataFrame functions only.  Runs are bucketed by key, so joining a batch against them does not
shuffle them; a batch is shuffled once, on keys of fixed size.  No line text is
shuffled but that of whole documents, once.

Defined results: a NULL or empty text is one empty line.  A NULL id is one document
below all others.  Rows that repeat an id are one document: they count once and keep or
lose the same lines.  An empty table gives an empty result.  All columns of the input
are kept; results are added under the names asked for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findmill.llm.tables import ascii_lower, durable, forget, packed, strip_spaces, unpacked
from findmill.session import shared_folder

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """What makes two lines the same: stripped at both ends, A-Z in lower case."""
    return ascii_lower(strip_spaces(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """Levelled sorted runs of line keys, as bucketed tables of the session's catalog."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.repartition(self.buckets, *KEY).write.option("path", f"{shared_folder(self.spark)}/{name}").bucketBy(
            self.buckets, *KEY
        ).sortBy(*KEY).saveAsTable(name)
        return name

    def _delete(self, name: str) -> None:
        forget(self.spark.table(name))
        self.spark.sql(f"DROP TABLE {name}")

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _plain(self, names: list[str]) -> list[DataFrame]:
        """Runs as plain files, without their buckets."""
        paths = [f"{shared_folder(self.spark)}/{name}" for name in names]
        return [self.spark.read.schema(self.spark.table(n).schema).parquet(p) for n, p in zip(names, paths)]

    def _put(self, name: str, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(self._write(totals(self._plain(old))), level + 1)
            for n in old:
                self._delete(n)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``(id, h1, h2)`` rows, each once, with ids below those of all earlier batches."""
        batch = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"))
        fresh = batch
        for run in self.tables():
            fresh = fresh.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        if self.tables():
            seen = batch.join(fresh.select(*KEY), KEY, "left_anti").withColumn("keeper", F.lit(None).cast("long"))
            batch = fresh.unionByName(seen)
        self._put(self._write(batch))

    def entries(self) -> DataFrame:
        """Each key once, with its documents over all runs."""
        return totals(self._plain([name for level in self.levels for name in level]))

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self._delete(name)
        self.levels = []


def totals(runs: list[DataFrame]) -> DataFrame:
    """Runs merged: one row a key.

    The runs must come as plain files: this Spark version takes a union of bucketed tables for one table
    dealt by key, leaves the exchange out, even an explicit one, and so leaves keys twice.
    """
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return merged.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``(id, h1, h2)`` of each distinct line key of at least ``min_chars`` code points of a document."""
    lines = docs.select(F.col(doc_id).alias("id"), F.explode(_lines(F.col(text))).alias("line"))
    lines = lines.select("id", strip_spaces(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return lines.select("id", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")).distinct()


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
    batches: int = 4, fanout: int = 3,
    kept: str = "kept_text", n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """``docs`` with the text left (``kept``), the lines before and the lines dropped.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents
    loses all its lines except those of the largest id that holds it.
    """
    spark = docs.sparkSession
    lines = durable(line_hashes(docs, doc_id, text, min_chars), "line-hashes")
    shares = [i / batches for i in range(1, batches)] or [0.0]
    cuts = lines.agg(F.percentile_approx("id", shares)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    runs = LineRuns(spark, fanout)
    above = None
    for low in [*cuts, None]:
        part = lines if low is None else lines.where(F.col("id") > low)
        if above is not None:
            part = part.where((F.col("id") <= above) | (F.col("id").isNull() if low is None else F.lit(False)))
        runs.add(part)
        above = low
    # written first: a join of two tables can split the lines of a key that very many documents hold
    frequent = durable(runs.entries().where(F.col("docs") >= min_docs).select(*KEY, "keeper"), "frequent-lines")
    doomed = lines.join(frequent.hint("merge"), KEY).where(~F.col("id").eqNullSafe(F.col("keeper")))
    # the 128-bit key has decided; inside one document 64 bits tell its lines apart
    doomed = durable(doomed.groupBy("id").agg(F.collect_set("h1").alias("doomed")), "doomed-lines")
    runs.drop()
    forget(lines, frequent)
    rows = packed(docs, own=F.col(doc_id), body=F.coalesce(F.col(text), F.lit("")))
    # always by key: whether the doomed lines would fit a broadcast must not decide the plan
    joined = rows.join(doomed.hint("merge"), F.col("own").eqNullSafe(F.col("id")), "left")
    left = F.filter(
        _lines(F.col("body")),
        lambda line: ~((F.char_length(strip_spaces(line)) >= min_chars)
                       & F.array_contains(F.col("doomed"), F.xxhash64(line_key(line)))),
    )
    some = F.col("doomed").isNotNull()
    joined = joined.withColumns({"some": some, "left": F.when(some, left), "lines": F.size(_lines(F.col("body"))).cast("long")})
    return unpacked(joined, docs.columns, **{
        n_lines: F.col("lines"),
        n_dropped: F.when(F.col("some"), F.col("lines") - F.size("left")).otherwise(F.lit(0)).cast("long"),
        kept: F.when(F.col("some"), F.array_join("left", "\n")).otherwise(F.col("body")),
    })
