"""Exact dedup and line dedup against brute force on odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from findmill.llm import exact_dedup, line_dedup

SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, kept string"


def texts(seed, n=150):
    rng = random.Random(seed)
    base = ["x" * 47, "x" * 48, "x" * 49, "y" * 5000, "y" * 5001, "z" * 300_000, "é" * 40, "", " ", "a b", "ab", "a\nb", "Ab", " "]
    rows = []
    for i in range(n):
        t = rng.choice(base + [rng.choice("xy") * rng.randint(0, 60)])
        if rng.random() < 0.4:
            t = t[: len(t) // 2] + rng.choice([" ", "\n\t", "\x0b"]) + t[len(t) // 2 :]
        rows.append((i // 2 * 2 if rng.random() < 0.2 else i, None if rng.random() < 0.05 else t, "k"))
    return rows + rows[:5]


@pytest.mark.parametrize("seed,width,growth", [(1, 48, 96), (2, 1, 3)])
def test_exact_groups(spark, seed, width, growth):
    rows = [r for r in texts(seed) if width > 1 or len(r[1] or "") < 200]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA), width=width, growth=growth).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), i))
    expected = sorted(
        (i, min(g)[1], len(g), hashlib.sha256(norm.encode()).hexdigest()) for norm, g in groups.items() for _, i in g
    )
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_groups_without_ids_and_rows(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b b")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()}
    assert got == {(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)}
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def line_rows(seed, n=120):
    rng = random.Random(seed)
    long = [f"{c} " * 25 for c in "abcdefg"] + ["É" * 40, "é" * 40, "x" * 39, "x" * 40, "y" * 39 + "日"]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(long + ["", " ", "short"])
            lines.append(rng.choice(["", " ", "\t"]) + (line.upper() if rng.random() < 0.3 and line.isascii() else line) + rng.choice(["", "\r"]))
        rows.append((rng.randint(0, n), "\n".join(lines) if rng.random() > 0.05 else None, "kept"))
    return rows + rows[:4]


def brute_lines(rows, min_chars, min_docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    doomed = {k: max(h) for k, h in holders.items() if len(k) >= min_chars and len(h) >= min_docs}
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if doomed.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("seed,batches,fanout,min_docs", [(1, 4, 3, 5), (2, 1, 2, 2), (3, 6, 2, 3)])
def test_lines(spark, seed, batches, fanout, min_docs):
    rows = line_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = line_dedup.dedup_lines(df, min_docs=min_docs, batches=batches, fanout=fanout).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute_lines(rows, 40, min_docs)
    assert all(r.kept == "kept" for r in got)


def test_lines_of_rows_without_id_and_of_no_rows(spark):
    line = "w" * 40
    df = spark.createDataFrame([(None, line)] + [(i, line) for i in range(4)], "doc_id long, text string")
    got = {(r.doc_id, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {(None, 1, ""), (0, 1, ""), (1, 1, ""), (2, 1, ""), (3, 0, line)}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_runs_find_what_they_have_seen(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    for ids in ([9, 8], [7, 6], [5]):
        runs.add(spark.createDataFrame([(i, 1, 1) for i in ids] + [(ids[0], ids[0], 0)], "id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 1]
    got = {(r.h1, r.h2): (r.docs, r.keeper) for r in runs.entries().collect()}
    assert got == {(1, 1): (5, 9), (9, 0): (1, 9), (7, 0): (1, 7), (5, 0): (1, 5)}
    runs.drop()


def test_line_dedup_plan_is_native(spark, sf_dir):
    from findmill.llm import queries

    plan = queries.op8_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow", "Cartesian", "NestedLoop"))


def test_digits_stop_widening_where_a_length_ends(spark):
    # digits of 2 and 4 bytes, then of as many as an INT allows
    text = "abcdefgh" * 20_000
    rows = [(1, text), (2, text), (3, text[:-1] + "x"), (4, text[:5]), (5, "ab")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=2, growth=2**29).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}


def test_a_line_that_a_third_of_the_documents_hold(spark):
    hot = "one very common line of more than forty characters"
    rows = [(i, f"{hot}\nown text of document {i}" if i % 3 == 0 else f"own text of document {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = {r.doc_id: (r.kept_text, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert len(got) == 3000
    assert got[2997] == (f"{hot}\nown text of document 2997", 0)
    assert all(got[i] == (f"own text of document {i}", int(i % 3 == 0)) for i in range(3000) if i != 2997)


def test_exact_groups_of_rows_dealt_anew(spark):
    from pyspark.sql import functions as F

    rows = [(i % 50, "same words " * (1 + i % 4) + " " * (i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, F.rand())
    got = exact_dedup.exact_groups(df, width=4, growth=2).collect()
    assert len(got) == 400 and {r.group_size for r in got} == {100}
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got}) == 4
