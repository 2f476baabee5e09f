"""Toxicity, mixing and nearest neighbours against brute force and held-out rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from findmill.llm import lsh_forest, mixing, queries, toxicity


def test_clauses_are_scored_not_words():
    scorer = toxicity.Scorer({"idiot$": 6.0, "idio": 5.0})
    first = lambda text: scorer.features(text)[0]
    plain, target = first("what an idiot"), first("you are an idiot")
    assert plain == 6.0 and target > plain
    assert first("she is not an idiot") < target and first("he said an idiot came") < target
    assert first('"idiot"') < plain
    assert first("not now, they all went home, idiot") > first("not an idiot, they all went home")
    assert first("nice") == 0.0 and scorer.features(None) == [0.0] * toxicity.FEATURES
    assert toxicity.Scorer({}).features("i will kill you")[0] > 0
    assert toxicity.Scorer({}).features("kill")[0] == 0.0
    assert scorer.features("idiot. idiot!\nidiotic")[:2] == [6.0, 6.0]


def test_steps_of_the_composed_machine_are_those_of_its_parts():
    grammar, rng = toxicity.Grammar(), random.Random(1)
    for _ in range(300):
        state = parts = (0,) * len(toxicity.MACHINES)
        for _ in range(10):
            symbol = rng.randrange(7)
            state, _ = grammar.step(state, symbol)
            parts = tuple(m(s, symbol) for m, s in zip(toxicity.MACHINES, parts))
            assert state == parts


def test_fold_is_crc32(spark):
    rows = spark.createDataFrame([(i,) for i in [0, 7, 123456, None]], "doc_id long").select("doc_id", toxicity.fold(F.col("doc_id")).alias("f"))
    assert all(r.f == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5) for r in rows.collect())


def test_held_out_rows_are_told_apart(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "el", "io", "um")]
    rows = []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2):
                text.insert(rng.randint(0, len(text)), rng.choice(["moronic", "moron", "dolt"]))
        rows.append((i, " ".join(text), int(toxic), "x"))
    df = spark.createDataFrame(rows + [(None, "moron", 1, "x"), (2000, None, None, "x"), (2001, "", None, "x")], "doc_id long, text string, toxic int, pattern string")
    model = toxicity.learn(df, "text", "toxic", "doc_id")
    scored = toxicity.score(df, model).where("toxic IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 = 0").collect()
    wrong = sum((r.score >= 0.5) != bool(r.toxic) for r in scored)
    assert len(scored) > 200 and wrong <= 2
    assert all(0 <= r.score <= 1 and r.pattern == "x" for r in toxicity.score(df, model).collect())


def test_labels_of_one_kind_or_none(spark):
    df = spark.createDataFrame([(i, "a b", 1) for i in range(20)], "doc_id long, text string, toxic int")
    score = lambda d: {r.score for r in toxicity.score(df, toxicity.learn(d, "text", "toxic", "doc_id")).collect()}
    assert score(df) == {1.0} and score(df.limit(0)) == {0.0} and score(df.withColumn("toxic", F.lit(None).cast("int"))) == {0.0}


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 0.7}, {"a": 1}, {c: i + 1 for i, c in enumerate("abcdefghij")}])
def test_every_prefix_is_within_one_block(weights):
    parts = mixing.parts_of(weights, 1000)
    assert sum(parts.values()) == 1000
    slots = mixing.period(parts)
    order = {at: s for s, own in slots.items() for at in own}
    assert sorted(order) == list(range(1000))
    counts = Counter()
    for at in range(1000):
        counts[order[at]] += 1
        assert all(abs(counts[s] - (at + 1) * parts[s] / 1000) < 1 for s in parts)
    for s, own in slots.items():
        for j, at in enumerate(own):
            assert j * 1000 // parts[s] <= at < -(-(j + 1) * 1000 // parts[s])


def test_mix_is_the_schedule(spark):
    rng = random.Random(5)
    rows = [(i % 190, "x" * rng.randint(0, 300), rng.choice(["a", "a", "a", "b", "c", None]), "keep") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __slot string")
    plan = mixing.plan_mix(df, {"a": 1, "b": 1, "c": 1, "": 1}, block_bytes=500, max_epochs=2, resolution=100)
    got = mixing.mix(df, plan, block_bytes=500, max_epochs=2, bucket_rows=7).collect()
    for s in {"a", "b", "c", ""}:
        own = [(len(t), i) for i, t, src, _ in rows if (src or "") == s]
        assert plan.blocks[s] == max(1, -(-sum(n for n, _ in own) // 500))
        for epoch in range(2):
            mine = [r for r in got if (r.source or "") == s and r.epoch == epoch]
            starts, begun = Counter(), 0
            for r in mine:
                starts[r.block] += len(r.text)
                at = mixing.slot_of(plan.slots[s], 100, epoch * plan.blocks[s] + r.block)
                assert r.slot == at < plan.end and r["__slot"] == "keep"
            whole = [b for b in range(plan.blocks[s]) if mixing.slot_of(plan.slots[s], 100, epoch * plan.blocks[s] + b) < plan.end]
            if len(whole) == plan.blocks[s]:
                assert sorted((len(r.text), r.doc_id) for r in mine) == sorted(own)
            # a block starts within one document of its place
            for b in whole:
                assert sum(starts[k] for k in range(b)) >= b * 500 - 300 or not mine
    assert max(r.slot for r in got) < plan.end
    once = max(mixing.slot_of(plan.slots[s], 100, plan.blocks[s] - 1) + 1 for s in plan.blocks)
    assert plan.end <= once
    ordered = mixing.in_order(mixing.mix(df, plan, block_bytes=500, max_epochs=2, bucket_rows=7), plan.end, partitions=3).collect()
    assert [r.slot for r in ordered] == sorted(r.slot for r in got)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df, mixing.plan_mix(df)).count() == 0
    one = spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id long, text string, source string")
    assert mixing.mix(one, mixing.plan_mix(one)).count() == 2


def mixed_counts(df, weights=None, **options):
    plan = mixing.plan_mix(df, weights, **options)
    mixed = mixing.mix(df, plan, **options)
    parts = mixing.in_order(mixed, plan.end, partitions=4, plan=plan).select(F.spark_partition_id().alias("part")).collect()
    return plan, mixed.groupBy("doc_id", "source").count().collect(), Counter(r.part for r in parts)


@pytest.mark.parametrize("rows", [3_000, 60_000])
def test_one_row_without_source_does_not_end_the_mix(spark, rows):
    """Beside it a source thousands of blocks large, below and above the period."""
    df = spark.range(rows).selectExpr("id AS doc_id", "repeat('x', IF(id = 0, 1, 100)) AS text", "IF(id = 0, NULL, 'hot') AS source")
    plan, got, parts = mixed_counts(df, block_bytes=100)
    assert len(got) == rows and max(r["count"] for r in got) <= 4
    # nor does it make the large one repeat
    assert sum(r["count"] for r in got if r.source) < rows and plan.end <= rows + 2
    assert max(parts.values()) <= 1.1 * sum(parts.values()) / 4


def test_small_source_gives_up_its_slots(spark):
    """200 to 1 in size, and a source that most of the weight goes to."""
    df = spark.range(2010).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "IF(id < 10, 'small', 'hot') AS source")
    for weights in (None, {"small": 9, "hot": 1}):
        plan, got, parts = mixed_counts(df, weights, block_bytes=100)
        assert len(got) == 2010 and {r["count"] for r in got if r.source == "small"} == {4}
        assert {r["count"] for r in got if r.source == "hot"} == {1}
        assert max(parts.values()) <= 1.1 * sum(parts.values()) / 4


def test_more_sources_than_parts_and_empty_texts(spark):
    df = spark.range(12_000).selectExpr("id AS doc_id", "IF(id < 100, '', 'xy') AS text", "CAST(id % 11000 AS string) AS source")
    assert len(mixed_counts(df)[1]) == 12_000
    # 64 full blocks, and empty texts wherever their hash puts them
    df = spark.range(128).selectExpr("id AS doc_id", "IF(id % 2 = 0, '', repeat('x', 10)) AS text", "'s' AS source")
    plan, got, _ = mixed_counts(df, block_bytes=10)
    assert plan.blocks == {"s": 64} and len(got) == 128 and {r["count"] for r in got} == {1}


def brute_nearest(rows, asked, k):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, v in ok:
        if i is not None and asked(i):
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out[i] = near
    return out


def test_nearest_on_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(100, None), (200, []), (300, [0.0] * 6), (400, [1.0, None] + [0.0] * 4), (500, [float("nan")] * 6), (600, [float("inf")] + [0.0] * 5)]
    rows += [(700, [1.0, 2.0]), (701, [1.0, 2.5]), (800, [3.0]), (900, rows[3][1]), (901, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, shard string")
    expected = brute_nearest(rows, lambda i: i % 10 == 0, 10)
    # a forest that hands over all rows of a shard is exact
    got = lsh_forest.nearest(df, F.col("vec_id") % 10 == 0, share=1.0, shard_rows=16).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert {q: [v for _, v in n] for q, n in found.items()} == {q: [v for _, v in n] for q, n in expected.items() if n}
    assert all(np.allclose([s for s, _ in n], [s for s, _ in expected[q]]) for q, n in found.items())
    assert lsh_forest.nearest(df.limit(0), F.lit(True)).count() == 0


def test_prefixes_are_descended_and_ascended():
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((500, 8))
    forest = lsh_forest.Forest(vectors, 5)
    all_keys = forest.keys(vectors)
    for q in rng.standard_normal((20, 8)):
        keys = forest.keys(q[None])[:, 0]
        prefix = np.max([[64 - int(a ^ b).bit_length() for a in tree] for tree, b in zip(all_keys, keys)], axis=0)
        for wanted in (1, 20, 400):
            level = sorted(prefix)[-wanted]
            assert set(forest.candidates(keys, wanted)) == set(np.flatnonzero(prefix >= level))


def test_recall_of_the_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected = brute_nearest(rows, lambda i: i % 100 == 0, 10)
    got = queries.op9_lsh_forest(spark, sf_dir).collect()
    hits = sum((r.query_id, r.vec_id) in {(q, v) for q, n in expected.items() for _, v in n} for r in got)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    exact = {(q, v): s for q, n in expected.items() for s, v in n}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-9 for r in got if (r.query_id, r.vec_id) in exact)
