"""Jaccard join: blocking, DivideSkip and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from findmill.llm import ngram_join as nj
from findmill.llm.components import components


def brute_sets(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return set()
    n = min(words, len(found))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}


def brute_components(rows, words, threshold):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(brute_sets(t, words))
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in ids}


def corpus(seed, n=120):
    """Texts of all lengths with near copies at many distances."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["A", "É", "the"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                if words:
                    k = rng.randrange(len(words))
                    words[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 15, 40, 120, 300]))]
            if rng.random() < 0.3:
                words += passage
        rows.append((i * 7 % 1000 + 1, rng.choice([" ", "\n", "  "]).join(words) if rng.random() > 0.03 else None))
    return rows


def agree(a, b):
    """Whether two sets share as many signatures as the tags of one of their common classes ask of each."""
    low = (1 << nj.NEED_BITS) - 1
    return any(
        ta >> nj.NEED_BITS == tb >> nj.NEED_BITS and len(np.intersect1d(sa, sb)) >= max(1, ta & low, tb & low)
        for ta, sa in a.items() for tb, sb in b.items()
    )


@pytest.mark.parametrize("words,threshold", [(4, 85), (5, 80)])
def test_linked_sets_share_a_signature(words, threshold):
    rows = corpus(3, 200) + corpus(4, 200)
    sets = [nj.shingles(t, words) for _, t in rows]
    marks = [dict(nj.signatures(s, threshold)) for s in sets]
    linked = 0
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            both = len(np.intersect1d(x, y))
            if both and 100 * both >= threshold * (len(x) + len(y) - both):
                linked += 1
                assert agree(marks[i], marks[j])
    assert linked > 100


@pytest.mark.parametrize("n", range(1, 90))
def test_signatures_at_the_limit_of_the_difference(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = rng.integers(0, n + 1)
        y = np.unique(np.concatenate((x[drop:], rng.integers(0, 2**63, rng.integers(0, n // 5 + 1), dtype=np.uint64))))
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 85 * (len(x) + len(y) - both):
            assert agree(dict(nj.signatures(x, 85)), dict(nj.signatures(y, 85)))


@pytest.mark.parametrize("parts_of_larger", [1, 2])
def test_set_in_one_part_shares_what_it_asks_for(parts_of_larger):
    """4 shingles whose hashes fall in one part, and 5 that hold them: 0.80, a link."""
    small = np.arange(1, 5, dtype=np.uint64)
    large = np.append(small, np.uint64(5) if parts_of_larger == 1 else np.uint64(1 << 63))
    known = [{tag >> nj.NEED_BITS: (tag % (1 << nj.NEED_BITS), set(marks.tolist())) for tag, marks in nj.signatures(x, 80)} for x in (small, large)]
    both = known[0].keys() & known[1].keys()
    # in one class at least both have as many lists of two as they ask for
    assert any(len(known[0][c][1] & known[1][c][1]) >= max(known[0][c][0], known[1][c][0]) for c in both)


def test_rows_with_a_neighbour_are_kept_across_batches():
    import pyarrow as pa

    rng = random.Random(8)
    for _ in range(50):
        marks = sorted(rng.choice(range(30)) for _ in range(rng.randint(1, 40)))
        table = pa.table({"id": list(range(len(marks))), "tag": [0] * len(marks), "signature": marks})
        got = [r["id"] for b in nj._shared(iter(table.to_batches(max_chunksize=rng.randint(1, 5)))) for r in b.to_pylist()]
        assert got == [i for i, m in enumerate(marks) if marks.count(m) > 1]


@pytest.mark.parametrize("entries", [0, 10_000])
@pytest.mark.parametrize("few", [0, 3, 1000])
@pytest.mark.parametrize("mu", [0.0085, 1.0])
@pytest.mark.parametrize("seed", range(4))
def test_t_occurrence_counts(monkeypatch, seed, mu, entries, few):
    monkeypatch.setattr(nj, "MU", mu)
    monkeypatch.setattr(nj, "HEAP_ENTRIES", entries)
    monkeypatch.setattr(nj, "FEW", few)
    rng = np.random.default_rng(seed)
    sets = [np.sort(rng.choice(np.arange(60, dtype=np.uint64), rng.integers(1, 50), replace=False)) for _ in range(40)]
    inverted = nj.Lists(sets)
    for x in range(40):
        lists = inverted.of(x)
        counts = Counter(y for k in lists for y in inverted.owner[inverted.starts[k] : inverted.ends[k]].tolist())
        for threshold in range(1, len(lists) + 2):
            values, found = inverted.t_occurrence(lists, threshold, lambda v: v % 3 > 0)
            expected = {v: c for v, c in counts.items() if c >= threshold and v % 3}
            assert dict(zip(values.tolist(), found.tolist())) == expected


@pytest.mark.parametrize("seed,rows,parts", [(1, 4096, 4_000_000), (2, 4096, 4_000_000), (3, 3, 4_000_000), (4, 4096, 300)])
def test_same_components_as_brute_force(spark, monkeypatch, seed, rows, parts):
    monkeypatch.setattr(nj, "BLOCK_ROWS", rows)
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", parts)
    data = corpus(seed)
    data += [data[0], (5000, "a b c"), (5001, "A  b\tc"), (5002, "a b c d"), (5003, ""), (5004, None)]
    df = spark.createDataFrame([(*r, "x") for r in data] + [(None, "a b c", "x")], "doc_id long, text string, id string")
    got = nj.similar_documents(df, words=4, threshold=85).collect()
    assert len(got) == len(data) + 1
    expected = brute_components(data, 4, 85)
    for r in got:
        assert r.component_id == (expected[r.doc_id] if r.doc_id is not None else None)
    sizes = {i: len(brute_sets(t, 4)) for i, t in data}
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == sizes


def test_empty_table(spark):
    assert nj.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_many_near_copies_are_one_component():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = []
    for _ in range(1500):
        keep = rng.random(len(base)) > 0.03
        sets.append(np.unique(np.concatenate((base[keep], rng.integers(0, 2**63, 8, dtype=np.uint64)))))
    sets.sort(key=len)
    assert len(nj.link_sets(sets, 80)) == 1499


def test_many_sets_just_below_the_threshold_take_seconds():
    import time

    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64))
    sets = []
    for _ in range(2000):
        keep = rng.random(len(base)) > 0.08
        sets.append(np.unique(np.concatenate((base[keep], rng.integers(0, 2**63, 8, dtype=np.uint64)))))
    sets.sort(key=len)
    start = time.perf_counter()
    links = nj.link_sets(sets, 85)
    assert time.perf_counter() - start < 60
    # a brute-force look at some sets: those in different components have no link
    component = list(range(len(sets)))
    for x, y in links:
        component = [component[x] if c == component[y] else c for c in component]
    for x in range(0, 2000, 97):
        for y in range(2000):
            both = len(np.intersect1d(sets[x], sets[y]))
            if x != y and 100 * both >= 85 * (len(sets[x]) + len(sets[y]) - both):
                assert component[x] == component[y]


def test_lists_shared_by_chance_join_no_block(spark):
    """Near copies in pairs, each set in one list with the next pair too: pairs stay apart, and none is cut."""
    need = 5
    tag = 3 << nj.NEED_BITS | need
    stars = []
    for k in range(0, 40, 2):
        # the pair has 9 lists, the first set counted in them too; the odd set is in one more list, of the pair before
        stars += [(k, k, tag, 4), (k, k, tag, 5), (k, k + 1, tag, 4), (k, k + 1, tag, 5)] + ([(k - 1, k + 1, tag, 1)] if k else [])
    stars += [(100, 101, tag, need - 1), (100, 100, tag, need - 1)]
    got = nj.star_links(spark.createDataFrame(stars, "a long, b long, tag long, lists long")).collect()
    assert sorted(map(tuple, got)) == [(k, k + 1) for k in range(0, 40, 2)]


@pytest.mark.parametrize("words,threshold", [(4, 85), (5, 80)])
def test_linked_sets_share_a_block(spark, words, threshold):
    """What is left of the lists' links joins all linked sets, and few others."""
    import pyarrow as pa

    rows = corpus(11, 150) + corpus(12, 150)
    sets = {nj._node(nj._digest(s)): s for s in (nj.shingles(t, words) for _, t in rows) if len(s)}
    marks = [(m, i, tag) for i, s in sets.items() for tag, found in nj.signatures(s, threshold) for m in found.tolist()]
    # copies of other tasks are in the stream again
    columns = [pa.array(c, pa.int64()) for c in zip(*sorted(marks + marks[::3]))]
    stream = pa.table(columns, names=["signature", "id", "tag"]).to_batches(max_chunksize=7)
    found = [r for b in nj._stars(nj._shared(nj._distinct(stream))) for r in zip(*(c.to_pylist() for c in b.columns))]
    links = nj.star_links(spark.createDataFrame(found, "a long, b long, tag long, lists long"))
    block = {r.node: r.component for r in components(links).collect()}
    linked = 0
    for i, x in sets.items():
        for j, y in sets.items():
            both = len(np.intersect1d(x, y))
            if i < j and 100 * both >= threshold * (len(x) + len(y) - both):
                linked += 1
                assert block.get(i, i) == block.get(j, j)
    assert linked > 50


def test_copies_of_other_tasks_make_no_list():
    import pyarrow as pa

    rows = pa.table({"id": [4, 4, 4, 5, 5, 6], "tag": [1] * 6, "signature": [7, 7, 8, 8, 8, 9]})
    for size in (1, 2, 6):
        got = [r for b in nj._shared(nj._distinct(rows.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert [(r["id"], r["signature"]) for r in got] == [(4, 8), (5, 8)]
