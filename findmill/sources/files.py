"""Source trees, uploads and archive manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findmill import vocab
from findmill.functions import paths
from findmill.functions.running import running_total
from findmill.functions.text import extension


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` as (path relative to root, length); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(_below(root).alias("path"), "length")


def read_source_files(spark: SparkSession, root: str, report_id: int | None = None) -> DataFrame:
    """Source files below ``root`` as (report_id, path, content).

    Without ``report_id`` the first folder below ``root`` names the report.  Bytes
    that are no UTF-8 become U+FFFD and every line ending becomes a line feed.
    Many tiny files: call once, write as Parquet, and work from that table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    inside = _below(root)
    if report_id is None:
        owner, path = F.split(inside, "/", 2)[0].try_cast("bigint"), F.split(inside, "/", 2)[1]
    else:
        owner, path = F.lit(report_id).cast("bigint"), inside
    return (
        files.select(owner.alias("report_id"), path.alias("path"), "content")
        .transform(admitted_source_files)
        .select("report_id", "path", F.regexp_replace(text, "\r\n?", "\n").alias("content"))
    )


def _below(root: str):
    base = root.rstrip("/") + "/"
    bare = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    return F.substring_index(bare, base.removeprefix("file:"), -1)


def admitted_source_files(files: DataFrame) -> DataFrame:
    """Keep source files (by lower-cased suffix) outside ignored directories."""
    path = F.col("path")
    return files.filter(paths.is_source(path) & ~paths.in_ignored_directory(path))


def admit_uploads(uploads: DataFrame, max_bytes: int = vocab.MAX_UPLOAD_BYTES) -> DataFrame:
    """Verdict and display name per upload (path, length)."""
    path = F.col("path")
    return uploads.withColumns(
        {
            "display_name": paths.stem(path),
            "verdict": F.when(F.lower(extension(path)) != "zip", "not_zip")
            .when(F.col("length") > max_bytes, "too_large")
            .otherwise("ok"),
        }
    )


def admit_members(members: DataFrame, max_bytes: int = vocab.MAX_EXTRACTED_BYTES) -> DataFrame:
    """Per archive member (archive_id, pos, name, size): is it kept, and the bytes so far.

    Folders and ignored members are skipped first; the rest count in member order.
    A member that leaves the archive is unsafe and its bytes do not count.
    """
    path = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    skipped = F.col("name").endswith("/") | paths.in_ignored_directory(path)
    flagged = members.withColumn("skipped", skipped).withColumn(
        "unsafe", ~F.col("skipped") & paths.escapes_root(path)
    )
    counted = F.when(F.col("skipped") | F.col("unsafe"), 0).otherwise(F.col("size"))
    return running_total(flagged, ["archive_id"], "pos", {"running_bytes": counted}).withColumn(
        "too_large",
        ~F.col("skipped") & ~F.col("unsafe") & (F.col("running_bytes") > max_bytes),
    )


def admit_archives(members: DataFrame, max_bytes: int = vocab.MAX_EXTRACTED_BYTES) -> DataFrame:
    """One verdict per archive: the first fault in member order rejects the whole archive."""
    fault = F.min(
        F.when(
            F.col("unsafe") | F.col("too_large"),
            F.struct("pos", F.when(F.col("unsafe"), "unsafe_path").otherwise("too_large").alias("why")),
        )
    )
    kept = ~F.col("skipped") & ~F.col("unsafe")
    return (
        admit_members(members, max_bytes)
        .groupBy("archive_id")
        .agg(
            fault.alias("fault"),
            F.count_if(kept).alias("members"),
            F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("bytes"),
        )
        .select(
            "archive_id",
            F.coalesce("fault.why", F.lit("ok")).alias("verdict"),
            F.col("fault.pos").alias("fault_pos"),
            "members",
            "bytes",
        )
    )
