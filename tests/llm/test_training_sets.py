"""Hard negatives, Merkle manifests and packing against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from functools import cache
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from findmill.llm import hard_negatives, merkle, packing

# --- hard negatives ----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, score string, id long"


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90):
    """Results by sorting all scores of each anchor."""
    best = {}
    for i, vec, label, *_ in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        best[i] = min(best.get(i, (label, vec)), (label, vec))
    quantized = {i: (label, [math.floor(256 * x) for x in vec]) for i, (label, vec) in best.items()}
    out = set()
    for a, (label, vec) in quantized.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), i, other) for i, (other, v) in quantized.items() if i != a and len(v) == len(vec))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and -low * p <= -100 * s[0] <= -high * p]
            out |= {(a, i, k, n, -p, -s) for k, (s, n, _) in enumerate(inside[:negatives], 1)}
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, VECTORS)
    found = hard_negatives.mine_negatives(df, F.col("vec_id") % 100 == 0, **options).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


@pytest.mark.parametrize("size, values", [(2, 3), (4, 40)])
def test_negatives_equal_sorting_all_scores(spark, monkeypatch, size, values):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 100)
    rng = random.Random(size)
    rows = [(i * 10, [rng.randint(-values, values) / values for _ in range(size)], rng.randint(0, 3), "x", 1) for i in range(-20, 400)]
    found = mined(spark, rows)
    assert found == brute_negatives(rows) and len(found) > 500


def test_a_positive_of_score_zero_has_negatives_of_score_zero(spark):
    rows = [(0, [1.0, 0.0], 1, "", 0), (9, [0.0, 1.0], 1, "", 0), (4, [0.0, 2.0], 2, "", 0), (12, [0.0, 3.0], 2, "", 0), (13, [-1.0, 0.0], 1, "", 0)]
    assert mined(spark, rows) == brute_negatives(rows) == {(0, 9, 1, 4, 0, 0), (0, 9, 2, 12, 0, 0)}


def test_negatives_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.random(), rng.random()], i % 3, "x", None) for i in range(300)]
    # a third of all rows are copies of one vector, with ids of their own
    rows += [(i, [0.5, 0.5], 1, "x", None) for i in range(300, 450)]
    rows += [rows[0], (100, [0.1, 0.2], 0, "x", 1), (7, [0.9, 0.9], 0, None, None)]
    rows += [(None, [1.0, 1.0], 1, "", 1), (500, None, 1, "", 1), (501, [1.0, 1.0], None, "", 1), (600, [math.nan, 1.0], 1, "", 1)]
    rows += [(700, [math.inf, 1.0], 1, "", 1), (800, [None, 1.0], 1, "", 1), (900, [], 1, "", 1), (901, [], 2, "", 1), (902, [], 1, "", 1), (1000, [1.0], 1, "", 1)]
    assert mined(spark, rows) == brute_negatives(rows)
    # scores of components this large leave the range of a long
    assert mined(spark, [(0, [1e300], 1, "", 1), (1, [1.0], 1, "", 1), (2, [0.5], 2, "", 1)]) == set()
    assert mined(spark, []) == set() and mined(spark, rows[1:50]) == set()


def test_exact_beyond_doubles(spark):
    big = float(2**20)
    rows = [(0, [big, 1 / 256], 1, "", 0), (1, [big, 3 / 256], 1, "", 0), (2, [big * 0.75, 2 / 256], 2, "", 0), (3, [big * 0.75, 1 / 256], 2, "", 0)]
    assert mined(spark, rows) == brute_negatives(rows) and len(brute_negatives(rows)) == 2


def test_packed_keys_sort_like_their_parts():
    parts = list(product([-5, 0, 3], [-(2**40), -1, 0, 7, 2**50], [0, 1], [-2, 0, 9]))
    keys = {}
    for a, s, role, i in parts:
        packed = hard_negatives.pack_keys(np.array([a]), np.array([s]), role, np.array([i]))
        assert [x.tolist() for x in hard_negatives.unpack_keys(packed)] == [[a], [s], [role], [i]]
        keys[packed[0].as_py()] = (a, -s, role, i)
    assert [keys[k] for k in sorted(keys)] == sorted(keys.values())


# --- Merkle manifest ---------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string, way int"


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute_leaf(doc):
    doc_id, text, lang, source, n_chars = doc[:5]
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in (doc_id, source, lang, n_chars, text)))


def brute_tree(leaves):
    """The root and each leaf's siblings, by building every level."""
    levels, ways = [leaves], [[] for _ in leaves]
    while len(levels[-1]) > 1:
        level = levels[-1]
        for i, way in enumerate(ways):
            at = i // 8 ** (len(levels) - 1)
            run = at // 8 * 8
            way.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        levels.append([H(*level[i : i + 8]) for i in range(0, len(level), 8)])
    return levels[-1][0], ways


def brute_proofs(docs):
    groups = defaultdict(list)
    for d in docs:
        groups[d[2]].append((d[0] is not None, d[0] or 0, brute_leaf(d)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([leaf for *_, leaf in sorted(groups[g])]) for g in order}
    root, tops = brute_tree([trees[g][0] for g in order])
    return sorted(
        (leaf, trees[g][0], root, tuple(way + top))
        for g, top in zip(order, tops) for (*_, leaf), way in zip(sorted(groups[g]), trees[g][1])
    )


def proved(spark, docs):
    df = spark.createDataFrame(docs, DOCS)
    found = merkle.proofs(merkle.build_manifest(df)).withColumn("up", merkle.climbed(F.col("digest"), F.col("way"))).collect()
    assert all(r.up == r.root for r in found)
    return sorted((r.digest, r.subroot, r.root, tuple(map(tuple, r.way))) for r in found)


def doc(i, text="some text", lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "x", "y", 1)


@pytest.mark.parametrize("sizes", [[1], [8], [9], [65], [513], [1, 1, 2], [600, 9, 1, 64, 3, 1, 1, 2, 8]])
def test_proofs_equal_those_of_whole_trees(spark, sizes):
    langs = [None, "", "de", "en", "zz", "é", "EN", "-", "="]
    docs = [doc(1000 * k + i, f"t {i}", langs[k]) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(docs)
    assert proved(spark, docs) == brute_proofs(docs)


def test_proofs_of_odd_rows(spark):
    docs = [doc(1, None), doc(1, ""), doc(1, None), doc(1, None), doc(None), doc(None, "b", None, None), doc(2, "x" * 2_000_000), doc(-3, "é\n", "de", "")]
    docs += [doc(7)] * 40
    assert proved(spark, docs) == brute_proofs(docs)
    assert proved(spark, []) == []


def test_a_changed_row_leads_elsewhere(spark):
    docs = spark.createDataFrame([doc(i, f"Text {i}") for i in range(100)], DOCS)
    changed = merkle.leaf_of(*[F.lower(f) if f == "text" else F.col(f) for f in merkle.FIELDS])
    found = merkle.proofs(merkle.build_manifest(docs, other=changed))
    found = found.select("root", merkle.climbed(F.col("other"), F.col("way")).alias("up"), merkle.siblings_hash(F.col("way")).alias("p"), "way")
    for r in found.collect():
        assert r.up != r.root and r.p == H(*(s for step in r.way for s in step))


# --- packing -----------------------------------------------------------------------------


def best_patterns(sizes, demand, capacity):
    """Fewest sequences, by trying every first sequence."""
    patterns = [p for p in product(*(range(d + 1) for d in demand)) if any(p) and sum(n * s for n, s in zip(p, sizes)) <= capacity]
    known = {tuple([0] * len(demand)): 0}

    def fewest(left):
        if left not in known:
            fitting = [p for p in patterns if all(a <= b for a, b in zip(p, left))]
            known[left] = 1 + min(fewest(tuple(b - a for a, b in zip(p, left))) for p in fitting)
        return known[left]

    return fewest(tuple(demand))


@pytest.mark.parametrize("sizes, demand, capacity", [([3, 4, 5], [4, 3, 3], 10), ([2, 7], [5, 3], 9), ([1, 6, 8], [3, 4, 2], 12), ([4], [6], 11)])
def test_patterns_hold_every_item_in_few_sequences(sizes, demand, capacity):
    patterns = packing.round_patterns(np.array(sizes), np.array(demand), capacity)
    assert sum(c * n for c, n in patterns).tolist() == demand
    assert all((c * np.array(sizes)).sum() <= capacity for c, _ in patterns)
    assert sum(n for _, n in patterns) <= best_patterns(sizes, demand, capacity) + 1


def test_patterns_are_near_the_bound():
    rng = np.random.default_rng(2)
    for shape in (rng.integers(1, 1000, 128), np.r_[rng.integers(1, 50, 64), np.zeros(63, int), 9], 10**9 // np.arange(1, 129) ** 2):
        sizes = np.flatnonzero(shape) + 1
        demand = shape[sizes - 1]
        patterns = packing.round_patterns(sizes, demand, 128)
        assert (sum(c.astype(object) * n for c, n in patterns) == demand).all()
        # items of more than half a sequence need one each
        bound = max(int((sizes * demand).sum()) / 128, int(demand[sizes > 64].sum()))
        assert sum(n for _, n in patterns) <= bound * 1.02 + len(sizes) // 2


def test_knapsack_equals_trying_all():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes, values = rng.integers(1, 8, 3), rng.random(3)
        value, counts = packing.knapsack(values, sizes, 15)
        most = max(sum(n * v for n, v in zip(c, values)) for c in product(range(16), repeat=3) if sum(n * s for n, s in zip(c, sizes)) <= 15)
        assert value == pytest.approx(most) and (counts * values).sum() == pytest.approx(most) and (counts * sizes).sum() <= 15


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def library(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library():
    import pyarrow as pa

    rng = random.Random(1)
    odd = list("aAzZ09 .,'\n\t\x1c\x1f\x85\xa0 ́éÉÀÿßª\xadİΣσς中文ﬁ½ẞ힣가ͅ\x00 ​÷×µ") + ["<|endoftext|>", "'s", "'LL", "'RE", "''t"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["don't STOP", "x" * 300_000, "<|startoftext|> a", "", "A" * 70 + "'ve"]
    ids, ends = packing.word_ids(packing.default_tokenizer()).texts(pa.array(texts))
    starts = [0, *ends[:-1].tolist()]
    assert all(ids[a:b].tolist() == library(t) for t, a, b in zip(texts, starts, ends.tolist()))


def check_packed(rows, found, length):
    """Every id in one piece, sequences gapless and full or a power of two."""
    expected = defaultdict(list)
    for key, text, *_ in rows:
        expected[key].append(library(text) + [2])
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        by_doc[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for key, wanted in expected.items():
        if len(wanted) == 1:
            pieces = sorted(by_doc[key])
            assert [i for _, ids, _ in pieces for i in ids] == wanted[0]
            assert [s for s, _, _ in pieces] == np.cumsum([0] + [len(i) for _, i, _ in pieces])[:-1].tolist()
            assert {n for *_, n in pieces} == {len(wanted[0])}
        else:
            # rows that repeat an id: all their ids, no more
            assert sorted(i for _, ids, _ in by_doc[key] for i in ids) == sorted(i for w in wanted for i in w)
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        sizes.append(at)
    assert all(s <= length and s & (s - 1) == 0 for s in sizes) and sorted(sequences) == list(range(len(sequences)))
    return sizes


PAGES = "doc_id long, text string, row long, size int, class string, sequence int"


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_hold_every_id_once(spark, monkeypatch, seed):
    monkeypatch.setattr(packing, "BUCKET", 128)
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["a", "tree", "Falls!", "élan"]) for _ in range(int(rng.paretovariate(0.7)) % 700)), 1, 1, "c", 1) for i in range(300)]
    # a third of the documents have one length
    rows += [(1000 + i, "one two three", 1, 1, "c", 1) for i in range(150)]
    df = spark.createDataFrame(rows, PAGES)
    sizes = check_packed(rows, packing.pack_documents(df, length=64, grain=4).collect(), 64)
    assert sum(s < 64 for s in sizes) <= 6


def test_packing_of_odd_rows(spark):
    rows = [(1, None, 1, 1, "", 1), (2, "", 1, 1, "", 1), (None, "no id", 1, 1, "", 1), (3, "b " * 50_000, 1, 1, "", 1), (4, "twin", 1, 1, "", 1), (4, "twin", 1, 1, "", 1)]
    df = spark.createDataFrame(rows, PAGES)
    check_packed(rows, packing.pack_documents(df).collect(), 4096)
    assert packing.pack_documents(df.limit(0)).collect() == []
    # ids that fill sequences exactly leave nothing to pack
    even = [(1, "b " * 127, 1, 1, "", 1), (2, "b " * 63, 1, 1, "", 1)]
    assert sorted(check_packed(even, packing.pack_documents(spark.createDataFrame(even, PAGES), length=64).collect(), 64)) == [64, 64, 64]


def test_crc_of_pieces(spark, sf_dir):
    from findmill.llm import queries

    docs = {r.doc_id: library(r.text) + [2] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op13_packing(spark, sf_dir).collect():
        ids = np.array(docs[r.doc_id], "<u4")[r.start : r.start + r.length]
        assert r.doc_tokens == len(docs[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids.tobytes())
