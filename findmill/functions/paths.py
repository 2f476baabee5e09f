"""Path columns (POSIX style)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from findmill import vocab
from findmill.functions.text import extension


def parts(path: Column) -> Column:
    """Path components without empty and '.' ones."""
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def in_ignored_directory(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, vocab.IGNORED_DIRECTORIES)))


def is_source(path: Column) -> Column:
    return F.lower(extension(path)).isin(vocab.SOURCE_EXTENSIONS)


def escapes_root(path: Column) -> Column:
    """Absolute, or climbing above its start at some component."""
    lowest = F.aggregate(
        parts(path),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, p: _climb(acc, p),
        lambda acc: acc["lowest"],
    )
    return path.startswith("/") | (lowest < 0)


def _climb(acc: Column, part: Column) -> Column:
    depth = acc["depth"] + F.when(part == "..", -1).otherwise(1)
    return F.struct(depth.alias("depth"), F.least(acc["lowest"], depth).alias("lowest"))


def file_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def stem(path: Column) -> Column:
    name, ext = file_name(path), extension(path)
    return F.when(ext == "", name).otherwise(
        F.left(name, F.char_length(name) - F.char_length(ext) - 1)
    )


def normalised(path: Column) -> Column:
    body = F.array_join(parts(path), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), body)).otherwise(body)


def relative_to(path: Column, root: Column) -> Column:
    """Path below ``root``; outside of it only the file name."""
    path, root = normalised(path), normalised(root)
    prefix = F.when(root == "/", root).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(path == root, F.lit("."))
        .when(path.startswith(prefix), F.substring(path, F.char_length(prefix) + 1, F.char_length(path)))
        .otherwise(file_name(path))
    )
