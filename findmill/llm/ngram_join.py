"""Jaccard self-join of documents on word n-grams, by T-occurrence search.

A document is the set of its distinct shingles of ``words`` words.  Two documents link when
``100 * intersection >= threshold * union``.

1. Blocking, without loss.  Two linked sets of at most N shingles differ in at most
   D = N * 2 (100 - threshold) / (100 + threshold) of them.  The space of shingles is cut into
   more than D parts, so linked sets agree in whole parts; each document emits a signature
   for each part (for its own class of sizes, and for the next one where a partner may be in
   it).  A set with f > D filled parts agrees with a partner in f - D of them at least, so a
   document that occurs in fewer lists of two or more has no partner and is left out.  A set
   with fewer filled parts emits its empty ones too and is left out if it is in no list.  The
   sets of a list are joined to the first of them: star links, never pairs.  Lists are
   read off a sorted stream in constant memory, and equal links are counted.
   A set leaves out the links of the fewest lists, of less than half the f - D lists
   together.  Two linked sets have at least f - D lists in common, of either's f, and together
   leave out fewer: in one list both stay with its first.  So what documents share by chance does not
   join their blocks, however many documents there are.
2. The components of the star links are blocks.  Each distinct set goes to its block once, as a
   text, which is smaller than its shingles.  A block with more rows or shingles than one task
   should hold is cut into parts, and each pair of parts is searched on its own.
3. T-occurrence search (DivideSkip).  Inside a block every set asks the inverted lists of its
   shingles for sets that occur in at least T of them.  The longest lists are put aside; the
   short ones are merged by a heap that skips ahead as soon as T can't be reached; what is
   left is probed in the long lists by binary search.  Above HEAP_ENTRIES entries the short
   lists are counted instead of merged, and above FEW candidates dense long lists are read as
   bit maps: the usual path in large blocks.  The occurrences found are the size of
   the intersection, so the link is decided exactly.  Sets already in one component need no
   further link, which keeps a block of thousands of near copies from comparing all of them.
4. Links become components.

Equal sets are represented by their smallest id.  A task emits the signatures of equal sets once, under
half of their digest, and copies of other tasks leave the lists before these are looked at, so copies
neither fill the lists nor make lists of their own.  Shingles are 64-bit hashes of the words'
64-bit hashes; equality of two whole sets is decided on 128 bits.

Defined results: a text with fewer words has its whole sequence as the one shingle; a text
without words, empty or NULL, has no shingle and links with nothing.  Rows that repeat an id
are one document with several texts.  A row without an id links with nothing and has no
component.  Only id and text are read, so further columns never clash.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from findmill.llm.components import components
from findmill.llm.tables import forget, grouped_runs, release_memory, settled

#: Growth of the classes of sizes, and the parts that shall be filled as a multiple of D + 1.
GROWTH, FILLED = 1.5, 1.1
#: The lists that a set must share are kept in the low bits of its class's tag.
NEED_BITS = 32
#: Rows and shingles that one search holds at most; more are cut into parts.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 4_000_000
#: Weight of the long lists' length in DivideSkip's choice of how many lists to put aside.
MU = 0.0085
#: Entries of short lists up to which a heap merges them; more are merged by counting.
HEAP_ENTRIES = 512
#: Digests that a task keeps to leave out copies, and rows of signatures that it hands over at a time.
KNOWN, HANDED = 200_000, 1 << 15
#: The lists are read in so many shares, one after the other, so that only one share of the signatures is on disk.
SHARES = 2
#: Rows of signatures that are looked at together.
COUNTED = 1 << 16
#: Candidates beyond which the long lists are probed as bit maps, one list after the other before.
FEW = 32


def _avalanche(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes.

    Words are separated by space and 0x09-0x0D; A-Z are lower-cased.
    """
    # bytes.lower and bytes.split know exactly these letters and separators
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(found))
    mixed = np.full(len(found) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(found) - n + 1 + k]
    return np.unique(_avalanche(mixed))


@cache
def size_classes(threshold: int) -> tuple[list[int], list[int], list[int]]:
    """Largest size, greatest difference and number of parts of each class of sizes."""
    tops, differences, parts = [1], [], []
    while tops[-1] < 1 << 32:
        tops.append(max(tops[-1] + 1, int(tops[-1] * GROWTH)))
    low = 1
    for top in tops:
        d = 2 * top * (100 - threshold) // (100 + threshold)
        smallest = max(1, math.ceil(threshold * low / 100))
        p = d + 1
        # so many parts that the smallest sets still fill more than d of them, but for rare ones
        while p < 4 * top:
            empty = math.exp(-smallest / p)
            spread = math.sqrt(p * empty * max(0.0, 1 - (1 + smallest / p) * empty))
            if p * (1 - empty) - 4 * spread >= FILLED * (d + 1) + 1:
                break
            p += max(1, p // 50)
        differences.append(d)
        parts.append(p)
        low = top + 1
    return tops, differences, parts


def signatures(tokens: np.ndarray, threshold: int) -> list[tuple[int, np.ndarray]]:
    """``(tag, signatures)`` for each class in which a partner may look for this set.

    There is a signature for each filled part.  The tag names the class and how many of them
    a partner has too at least.
    """
    n = len(tokens)
    if not n:
        return []
    tops, differences, parts = size_classes(threshold)
    out = []
    for c in range(bisect_left(tops, n), bisect_left(tops, 100 * n // threshold) + 1):
        p = parts[c]
        # the part grows with the hash, so the sorted shingles are sorted by part
        part = ((tokens >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums, filled = np.add.reduceat(tokens, starts), part[starts]
        # a set of no more filled parts than may differ is sure of one list only: with a partner of more filled
        # parts, which emits no empty ones, it shares as many as that one has more than differ
        need = max(1, len(filled) - differences[c])
        if len(filled) <= differences[c]:
            # such a set may agree with a partner in empty parts only
            empty = np.setdiff1d(np.arange(p, dtype=np.uint64), filled)
            sums, filled = np.concatenate((sums, np.zeros(len(empty), np.uint64))), np.concatenate((filled, empty))
        name = filled + np.uint64((c + 1) << 40)
        tag = c << NEED_BITS | need
        out.append((tag, _avalanche(sums + _avalanche(name)).view(np.int64)))
    return out


def _digest(tokens: np.ndarray) -> bytes:
    return xxh3_128_digest(tokens.tobytes())


def _node(digest: bytes) -> int:
    """The number of a set among the lists; should two sets have the same, they are searched together."""
    return int.from_bytes(digest[:8], "little", signed=True)


def shingle_sets(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """``(id, n, digest, node)`` of every row: the set's size, its digest and its number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for value in batch.column("text"):
                tokens = shingles(value.as_py(), words)
                sizes.append(len(tokens))
                digests.append(_digest(tokens))
            columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(map(_node, digests), pa.int64())]
            yield pa.record_batch([batch.column("id"), *columns], names=["id", "n", "digest", "node"])

    return _texts(docs, doc_id, text).mapInArrow(work, "id long, n long, digest binary, node long")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))


def signature_rows(docs: DataFrame, doc_id: str, text: str, words: int, threshold: int, share: int) -> DataFrame:
    """``(id, tag, signature)`` of the sets, ``id`` the set's number; of equal sets in one task the first speaks for all.

    Only signatures of one of ``SHARES`` shares, which has all rows of a list or none.
    """
    of = SHARES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            marks = []
            for value in batch.column("text"):
                tokens = shingles(value.as_py(), words)
                digest = _digest(tokens)
                if digest not in known:
                    marks += [(_node(digest), tag, m[m % of == share]) for tag, m in signatures(tokens, threshold)]
                    if len(known) >= KNOWN:
                        known.clear()
                    known.add(digest)
            if not marks:
                continue
            sizes = [len(m) for _, _, m in marks]
            columns = [np.repeat(np.array(c, np.int64), sizes) for c in list(zip(*marks))[:2]]
            rows = pa.record_batch([*map(pa.array, columns), pa.array(np.concatenate([m for *_, m in marks]))], names=["id", "tag", "signature"])
            # documents have hundreds of signatures: hand them over in small batches
            yield from (rows.slice(start, HANDED) for start in range(0, rows.num_rows, HANDED))
        release_memory()

    return _texts(docs, doc_id, text).where("id IS NOT NULL").mapInArrow(work, "id long, tag long, signature long")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``COUNTED`` rows or more."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= COUNTED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream sorted by (signature, id) without rows that are equal in both to the one before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks, ids = batch.column("signature").to_numpy(), batch.column("id").to_numpy()
        new = np.concatenate(([last != (marks[0], ids[0])], (marks[1:] != marks[:-1]) | (ids[1:] != ids[:-1])))
        last = marks[-1], ids[-1]
        yield batch.filter(pa.array(new))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a stream sorted by signature that have a neighbour with the same one."""
    held: pa.RecordBatch | None = None
    again = False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        marks = rows.column("signature").to_numpy()
        same = marks[1:] == marks[:-1]
        kept = np.concatenate(([again], same)) | np.concatenate((same, [False]))
        # whether the last row has a neighbour is known with the next batch
        held, again = rows.slice(len(marks) - 1), bool(kept[-1])
        out = rows.slice(0, len(marks) - 1).filter(pa.array(kept[:-1]))
        if out.num_rows:
            yield out
    if held is not None and again:
        yield held


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b, tag, lists)`` of a stream sorted by (signature, id): in how many lists with ``b`` ``a`` is the first, ``b`` itself included.

    Lists are counted batch by batch, so a link can come in several rows.
    """
    last_mark = last_first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks, ids, tags = (batch.column(c).to_numpy() for c in ("signature", "id", "tag"))
        starts = np.concatenate(([True], marks[1:] != marks[:-1]))
        firsts = ids[np.flatnonzero(starts)]
        if last_mark is not None and marks[0] == last_mark:
            firsts[0] = last_first
        first = firsts[np.cumsum(starts) - 1]
        last_mark, last_first = marks[-1], first[-1]
        order = np.lexsort((tags, first, ids))
        a, b, tag = first[order], ids[order], tags[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (tag[1:] != tag[:-1]))))
        yield pa.record_batch([*map(pa.array, (a[new], b[new], tag[new], np.diff(np.append(new, len(a)))))], names=["a", "b", "tag", "lists"])


def _counted(stars: DataFrame) -> DataFrame:
    return stars.groupBy("a", "b", "tag").agg(F.sum("lists").alias("lists"))


def star_links(stars: DataFrame) -> DataFrame:
    """``(a, b)``: what sets in enough lists keep of ``stars(a, b, tag, lists)``, links of the fewest lists left out.

    A set asks for ``need`` lists in common; so does its partner, and with less than half of them left out by
    each, one is left that both keep.
    """
    need = F.col("tag").bitwiseAND((1 << NEED_BITS) - 1)
    own = Window.partitionBy("b", "tag")
    fewest = own.orderBy("lists", "a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stars = _counted(stars).select("a", "b", need.alias("need"), F.sum("lists").over(own).alias("all"), F.sum("lists").over(fewest).alias("upto"))
    return stars.where("a <> b AND all >= need AND upto > (need - 1) DIV 2").select("a", "b")


def lists_aside(longest: int, lists: int, threshold: int) -> int:
    """How many of the longest lists DivideSkip puts aside."""
    aside = int(threshold / (MU * math.log2(longest + 1) + 1))
    return max(0, min(aside, threshold - 1, lists - 1))


def heap_merge(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """``(value, occurrences)`` of the values in at least ``need`` of the sorted ``lists``.

    Lists that can't take part in a value any more jump to the next one that they may.
    """
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= need:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            yield value, len(popped)
            following = value + 1
        else:
            # fewer than `need` lists stand at this value: no value before the next top can do it
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            following = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(lists[k], following, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))


def merge_short(entries: np.ndarray, number: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Values in at least ``need`` of the short lists, given one after the other, and their occurrences."""
    if len(entries) > HEAP_ENTRIES:
        counts = np.bincount(entries)
        values = np.flatnonzero(counts >= need)
        return values, counts[values]
    cuts = np.flatnonzero(number[1:] != number[:-1]) + 1
    merged = list(heap_merge([x.tolist() for x in np.split(entries, cuts)], need))
    values, found = zip(*merged) if merged else ((), ())
    return np.array(values, np.int64), np.array(found, np.int64)


class Lists:
    """Inverted lists of the shingles that several sets have; sets are sorted by size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        ends = np.append(starts[1:], len(tokens))
        shared = ends - starts > 1
        self.starts, self.ends, self.known = starts[shared], ends[shared], tokens[starts[shared]]
        self.lengths = self.ends - self.starts
        # lists that hold a good part of the sets are kept as bit maps too; their sizes bound their number
        dense = np.flatnonzero(self.lengths > max(FEW, len(sets) // 16))
        self.map_of = np.full(len(self.known), -1)
        self.map_of[dense] = np.arange(len(dense))
        self.maps = np.zeros((len(dense), len(sets)), bool)
        for row, k in enumerate(dense):
            self.maps[row, self.owner[self.starts[k] : self.ends[k]]] = True

    def of(self, x: int) -> np.ndarray:
        """The lists of a set's shingles, shortest first."""
        at = np.searchsorted(self.known, self.sets[x])
        inside = at < len(self.known)
        own, at = self.sets[x][inside], at[inside]
        at = at[self.known[at] == own]
        return at[np.argsort(self.lengths[at], kind="stable")]

    def entries(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of several lists, one after the other, and the number of each one's list."""
        sizes = self.lengths[lists]
        number = np.repeat(np.arange(len(lists)), sizes)
        shift = np.repeat(self.starts[lists] - (np.cumsum(sizes) - sizes), sizes)
        return self.owner[np.arange(len(number)) + shift], number

    def probe(self, lists: np.ndarray, values: np.ndarray) -> np.ndarray:
        """In how many of the (long) lists each of the values stands."""
        if len(values) <= FEW:
            # a set stands in the list of a shingle that it has: look for the shingles by binary search
            shingles = self.known[lists]
            found = []
            for v in values.tolist():
                at = np.searchsorted(self.sets[v], shingles)
                found.append(np.count_nonzero(self.sets[v][np.minimum(at, len(self.sets[v]) - 1)] == shingles))
            return np.array(found, np.int64)
        rows = self.map_of[lists]
        found = self.maps[np.ix_(rows[rows >= 0], values)].sum(axis=0)
        for k in lists[rows < 0]:
            one = self.owner[self.starts[k] : self.ends[k]]
            at = np.searchsorted(one, values)
            found = found + (one[np.minimum(at, len(one) - 1)] == values)
        return found

    def t_occurrence(self, lists: np.ndarray, threshold: int, wanted) -> tuple[np.ndarray, np.ndarray]:
        """Sets in at least ``threshold`` of the lists (shortest first), and their occurrences: DivideSkip.

        ``wanted`` tells which sets matter, for an array of them.
        """
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(lists) < threshold:
            return nothing
        aside = lists_aside(int(self.lengths[lists[-1]]), len(lists), threshold)
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        entries, number = self.entries(short)
        matter = wanted(entries)
        entries, number = entries[matter], number[matter]
        if not len(entries):
            return nothing
        values, found = merge_short(entries, number, threshold - aside)
        if not len(values):
            return nothing
        found = found + self.probe(long, values)
        return values[found >= threshold], found[found >= threshold]


def link_sets(sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links that join the sets, sorted by size, to the components of all their links."""
    sizes = np.array([len(s) for s in sets])
    inverted = Lists(sets)
    component = np.arange(len(sets))
    links: list[tuple[int, int]] = []

    def join(x: int, y: int) -> None:
        links.append((x, y))
        component[component == component[y]] = component[x]

    for x in range(1, len(sets)):
        n = int(sizes[x])
        least = -(-threshold * n // 100)
        first = int(np.searchsorted(sizes, least))
        wanted = -(-threshold * (n + least) // (100 + threshold))
        lists = inverted.of(x)
        if first >= x or len(lists) < wanted:
            continue
        # most sets of a block are near copies: one link to a large component spares its other members
        for k in lists[:1]:
            shortest = inverted.owner[inverted.starts[k] : inverted.ends[k]]
            shortest = shortest[(shortest >= first) & (shortest < x)]
            for y in shortest[-1:].tolist():
                same = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * same >= threshold * (n + int(sizes[y]) - same):
                    join(x, y)
        matter = np.zeros(len(sets), bool)
        matter[first:x] = component[first:x] != component[x]
        if not matter.any():
            continue
        for y, same in zip(*(c.tolist() for c in inverted.t_occurrence(lists, wanted, lambda v: matter[v]))):
            if component[y] != component[x] and 100 * same >= threshold * (n + int(sizes[y]) - same):
                join(x, y)
    return links


def _search(threshold: int, words: int):
    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = group.column("id").to_pylist()
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in group.column("tokens")]
        links = link_sets(sets, threshold)
        if links:
            a, b = zip(*links)
            yield pa.record_batch(
                [pa.array([ids[i] for i in a], pa.int64()), pa.array([ids[i] for i in b], pa.int64())], names=["a", "b"]
            )

    return lambda batches: grouped_runs(_tokens(batches, words), ["block", "i", "j"], work)


def _members(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(id, n, digest, block, i, j)``: each distinct set that shares its block, with the parts to search it in."""
    named = blocks.select("node", F.col("component").alias("block"))
    named = named.unionByName(named.select(F.col("block").alias("node"), "block").distinct())
    own = sets.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(*[F.min(c).alias(c) for c in ("id", "n", "node")])
    own = own.join(named.hint("merge"), "node").drop("node")
    sizes = own.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).where("rows > 1")
    sizes = sizes.select("block", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("parts"))
    own = own.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # a pair of parts also settles the pairs inside them
    other = other.where("parts = 1 OR other <> part")
    return other.select("id", "n", "digest", "block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def _tokens(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """``(block, i, j, id, tokens)`` of rows with texts, without those whose id stands for another text's set."""
    schema = pa.schema([("block", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("id", pa.int64()), ("tokens", pa.binary())])
    for batch in batches:
        rows = []
        for value, row in zip(batch.column("text"), batch.drop_columns(["text"]).to_pylist()):
            tokens = shingles(value.as_py(), words)
            if _digest(tokens) == row["digest"]:
                rows.append((row["block"], row["i"], row["j"], row["id"], tokens.tobytes()))
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, threshold: int = 80
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs``.

    ``component_id`` is the smallest id that can be reached by links, the document's own included.
    """
    sets = settled(shingle_sets(docs, doc_id, text, words), "shingle-sets")
    shares = []
    for share in range(SHARES):
        marks = signature_rows(docs, doc_id, text, words, threshold, share)
        marks = marks.repartition("signature").sortWithinPartitions("signature", "id")
        stars = marks.mapInArrow(lambda batches: _stars(_shared(_distinct(_gathered(batches)))), "a long, b long, tag long, lists long")
        shares.append(settled(_counted(stars), "star-links"))
    blocks = components(star_links(reduce(DataFrame.unionByName, shares)))
    forget(*shares)
    members = settled(_members(sets, blocks), "block-members")
    forget(blocks)
    # here and above by key at every size: whether a side would fit a broadcast must not decide the plan
    texts = _texts(docs, doc_id, text).join(members.hint("merge"), "id")
    found = texts.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "n", "id").mapInArrow(
        _search(threshold, words), "a long, b long"
    )
    equal = sets.where("n > 0 AND id IS NOT NULL").select("id", "digest")
    first = equal.groupBy("digest").agg(F.min("id").alias("a"))
    equal = equal.join(first, "digest").select("a", F.col("id").alias("b"))
    reached = components(found.unionByName(equal))
    forget(members)
    reached = reached.withColumnRenamed("node", "id")
    return sets.select("id", "n").join(reached, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
