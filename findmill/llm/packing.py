"""Packing of documents into training sequences, by cutting-stock column generation.

Documents become token ids, each ended by one more id.  Whole stretches of ``length`` ids are sequences
of their own; the rest of each document is an item to be packed with others.

1. Only the histogram of the items' lengths, in classes of ``grain`` ids, goes to the driver: at most
   ``length / grain`` counts, whatever the table.
2. The linear program over patterns (how many items of each class one sequence holds) starts with one
   pattern a class; a knapsack by dynamic programming prices further columns with the duals until none
   lowers the number of sequences.  Copies are rounded down; what is left over is filled greedily.
3. Items are ranked in their class on Spark, longest first.  The rounded patterns take the ranks of each
   class in turn, so an item's sequence follows from its class and rank by arithmetic.
4. Classes round lengths up, so sequences keep gaps.  As many sequences stay as the ids can fill; the
   least filled ones are taken apart again and their ids poured, in order, into the gaps of the others.
   Only these documents are cut.  The ids that are left when all is full go to sequences of a power of
   two each, which are not padded.  So no sequence is padded at all.

Every step on documents is a range, hash or key shuffle of narrow rows; ids are written once and move
once, to meet the cuts of their document.  No task holds more than one sequence or one bucket of ids.

Defined results: a NULL or empty text is the end id alone.  Rows that repeat an id are documents of their
own.  An empty table has no pieces.  Other columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from findmill.functions.running import running_total
from findmill.llm.byte_bpe import byte_table
from findmill.llm.ranks import ranked
from findmill.llm.tables import durable, forget

# --- token ids -------------------------------------------------------------------------

#: Words whose ids a worker keeps, each at most so many characters long; when full, it starts again.
MEMO, WORD = 600_000, 48
#: Bytes of text whose words are told apart at a time, and ids that are cut at a time.
TEXTS, IDS = 4 << 20, 1 << 20
# The parts of a tokenizer file that allow words to be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Texts of these characters only are split by Arrow; they are NFC already and have one lower-case letter each.
PLAIN = "^[\\t-\\r -~À-ÖØ-öø-ÿ]*$"
PLAIN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\t-\\r a-z0-9ß-öø-ÿ]+"


class WordIds(dict):
    """Packed ids of words, made by the library when a word is first met.

    For tokenizers that lower-case, drop white space and never join across it (``NORMALIZER`` and
    ``SPLIT``): the ids of a text are those of its words, one after the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        split = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"] if parts["pre_tokenizer"]["type"] == "Sequence" else None
        self.by_word = parts["normalizer"] == NORMALIZER and split == {"Regex": SPLIT}
        self.special = [t["content"] for t in parts["added_tokens"]]
        table = byte_table()
        self.as_bytes = {ord(c): "".join(table[b] for b in c.encode()) for c in map(chr, range(128, 256))}
        self.plain_word = re.compile("[!-~À-ÖØ-öø-ÿ]*")
        self.plain_split = re.compile(PLAIN_SPLIT)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self.pack([t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.as_bytes))])

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            found = self._piece(word.lower())
        elif self.plain_word.fullmatch(word) and not any(s in word for s in self.special):
            found = b"".join(map(self._piece, self.plain_split.findall(word.lower())))
        else:
            found = self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= WORD:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """Words, or the pieces of plain texts, whose ids follow each other in those of the texts."""
        plain = pc.match_substring_regex(texts, PLAIN)
        for special in self.special:
            plain = pc.and_not(plain, pc.match_substring(texts, special))
        pieces = pc.replace_substring_regex(pc.utf8_lower(texts), f"(?:{PLAIN_SPLIT})", r"\0 ")
        # Arrow cuts at the ASCII white space, across which nothing is joined
        return pc.ascii_split_whitespace(pc.if_else(plain, pieces, texts))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts, one after the other, and where each text ends."""
        # of other tokenizers each text is one word
        words = self._split(texts) if self.by_word else None
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py() if self.by_word else np.arange(1, len(texts) + 1)
        told = (words.flatten() if self.by_word else texts).dictionary_encode()
        packed = [self[w] for w in told.dictionary.to_pylist()]
        ids = np.frombuffer(b"".join(packed), f"<u{array(self.code).itemsize}")
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // ids.itemsize
        codes = told.indices.to_numpy()
        at = stretches((np.cumsum(sizes) - sizes)[codes], sizes[codes])
        until = np.concatenate(([0], np.cumsum(sizes[codes])))
        return ids[at], until[ends]


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def in_parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``, of one row at least."""
    number = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), len(sizes)]
    return zip(cuts, cuts[1:]) if len(sizes) else iter(())


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of stretches of ``values``."""
    offsets = np.concatenate(([0], ends)).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokens_of(docs: DataFrame, doc_id: str, text: str, path: str, end: int) -> DataFrame:
    """``(doc_id, n, width, ids)``: the little-endian ids of each row, of ``width`` bytes each, the end id included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in in_parts(pc.binary_length(texts).to_numpy(), TEXTS):
                ids, ends = ids_of.texts(texts.slice(a, b - a))
                ids = np.insert(ids, ends, end)
                ends = ends + np.arange(1, b - a + 1)
                width = pa.repeat(pa.scalar(ids.itemsize, pa.int32()), b - a)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(ends, prepend=0)), width, binaries(ids, ends)],
                    names=["doc_id", "n", "width", "ids"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, width int, ids binary")


# --- patterns --------------------------------------------------------------------------


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits, by dynamic programming over the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            gains = best[room - sizes[fits]] + values[fits]
            k = int(np.argmax(gains))
            if gains[k] > best[room] + 1e-12:
                best[room], choice[room] = gains[k], fits[k]
    counts, room = np.zeros(len(values), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), counts


def generate_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and their fractional copies, with nearly the fewest copies that meet the demand.

    Revised simplex; ends when the best dual bound so far shows that at most a share ``gap`` of the copies
    could be saved.  Columns are priced with duals drawn towards those of the best bound, which keeps them
    from swinging, and where that finds none with the duals themselves.
    """
    m = len(sizes)
    # no two demands alike: each exchange then makes headway, so none comes twice
    demand = demand + 1e-4 * (1 + np.modf(np.arange(m) * 0.6180339887)[0])
    columns, inverse = np.diag(capacity // sizes), np.diag(1.0 / (capacity // sizes))
    bound, center = 0.0, None
    # sums of products: linear algebra in threads can hang in the process that started the JVM
    times = lambda matrix, vector: (matrix * vector).sum(axis=-1)
    while True:
        copies, duals = times(inverse, demand), inverse.sum(axis=0)
        # items of negative duals are never taken
        able = np.maximum(duals, 0.0)
        for price in ([0.7 * center + 0.3 * able] if center is not None else []) + [able]:
            value, column = knapsack(price, sizes, capacity)
            # prices over the best pattern's value are feasible duals
            price = price / max(value, 1.0)
            if times(demand, price) > bound:
                bound, center = times(demand, price), price
            if times(duals, column) > 1 + 1e-7:
                break
        if copies.sum() <= (1 + gap) * bound or times(duals, column) <= 1 + 1e-7:
            return columns, np.maximum(copies, 0.0)
        direction = times(inverse, column)
        leaving = np.flatnonzero(direction > 1e-9)
        out = leaving[int(np.argmin(copies[leaving] / direction[leaving]))]
        columns[:, out] = column
        row = inverse[out] / direction[out]
        inverse = inverse - direction[:, None] * row
        inverse[out] = row


def round_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole copies of patterns that hold every item exactly once, the best filled patterns first."""
    columns, copies = generate_columns(sizes, demand.astype(float), capacity)
    left, out = demand.astype(object), []
    for k in np.argsort([capacity - int((c * sizes).sum()) for c in columns.T], kind="stable"):
        column = columns[:, k]
        used = np.flatnonzero(column)
        times = min([int(copies[k] + 1e-6), *(int(left[i]) // int(column[i]) for i in used)])
        if times > 0:
            left = left - column.astype(object) * times
            out.append((column, times))
    # fewer items than patterns times items are left: longest first, into what still fits
    while any(left):
        room, column = capacity, np.zeros(len(sizes), np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            take = min(int(left[i]), room // int(sizes[i]))
            column[i], room = take, room - take * int(sizes[i])
        times = min(int(left[i]) // int(column[i]) for i in np.flatnonzero(column))
        left = left - column.astype(object) * times
        out.append((column, times))
    return out


class Slots:
    """Sequence of each item by class and rank: the patterns take the ranks of a class in turn."""

    def __init__(self, classes: list[int], patterns: list[tuple[np.ndarray, int]]):
        self.sequences = 0
        ranges: dict[int, list[tuple[int, int, int]]] = {c: [] for c in classes}
        taken = dict.fromkeys(classes, 0)
        for column, times in patterns:
            for i in np.flatnonzero(column):
                each = int(column[i])
                ranges[classes[i]].append((taken[classes[i]], each, self.sequences))
                taken[classes[i]] += each * times
            self.sequences += times
        self.ranges = {c: tuple(np.array(x, np.int64) for x in zip(*r)) for c, r in ranges.items()}

    def of(self, classes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.empty(len(classes), np.int64)
        for c in np.unique(classes):
            at = np.flatnonzero(classes == c)
            first, each, sequence = self.ranges[int(c)]
            k = np.searchsorted(first, ranks[at], "right") - 1
            out[at] = sequence[k] + (ranks[at] - first[k]) // each[k]
        return out


# --- pieces ----------------------------------------------------------------------------

#: Ids of gaps and of documents poured into them that meet in one group.
BUCKET = 1 << 16


def pour(gaps: DataFrame, items: DataFrame, total: int) -> DataFrame:
    """Pieces ``(row, start, length, sequence, offset)`` of the items' ids, in order of ``row``, in the gaps.

    Gaps are ``(sequence, gap, offset)`` in order of ``sequence``, items ``(row, start, size)``; both hold
    ``total`` ids.  Both are laid along one line of ids; between two neighbouring starts lies one piece.
    """
    def along(df: DataFrame, order: str, size: str) -> DataFrame:
        ends = running_total(df, [], order, {"end": F.col(size)}, width=2000)
        ends = ends.withColumn("begin", F.col("end") - F.col(size))
        # an interval is marked in each bucket that it reaches, cut at the bucket's start
        ends = ends.withColumn("bucket", F.explode(F.sequence(F.expr(f"begin div {BUCKET}"), F.expr(f"(end - 1) div {BUCKET}"))))
        return ends.withColumn("x", F.greatest("begin", F.col("bucket") * BUCKET))

    gap = along(gaps, "sequence", "gap").select("bucket", "x", F.struct("begin", "sequence", "offset").alias("gap"))
    item = along(items, "row", "size").select("bucket", "x", F.struct("begin", "row", "start").alias("item"))
    line = gap.unionByName(item, allowMissingColumns=True)
    order = Window.partitionBy("bucket").orderBy("x")
    pieces = line.select(
        "x", F.last("gap", True).over(order).alias("gap"), F.last("item", True).over(order).alias("item"),
        (F.coalesce(F.lead("x").over(order), F.least((F.col("bucket") + 1) * BUCKET, F.lit(total))) - F.col("x")).alias("length"),
    ).where("length > 0")
    pieces = pieces.select(
        "item.row", (F.col("item.start") + F.col("x") - F.col("item.begin")).alias("start"), "length",
        "gap.sequence", (F.col("gap.offset") + F.col("x") - F.col("gap.begin")).alias("offset"),
    )
    # an item and a gap have one stretch in common; it may reach over two buckets
    return pieces.groupBy("row", "sequence").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.min("offset").alias("offset"))


def _cut(length: int, first_full: int):
    """The pieces of documents, from their ids, whole sequences and cuts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = batch.column("width")[0].as_py()
            n, full = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "full"))
            whole = n // length
            cuts = batch.column("cuts")
            flat = cuts.flatten()
            rows = np.concatenate((np.repeat(np.arange(len(n)), whole), pc.list_parent_indices(cuts).to_numpy()))
            nth = stretches(np.zeros(len(n), np.int64), whole)
            first = np.repeat(np.nan_to_num(full).astype(np.int64), whole)
            of_whole = [nth * length, np.full(len(nth), length), first_full + first + nth, np.zeros(len(nth), np.int64)]
            start, size, sequence, offset = (
                np.concatenate((w, flat.field(c).to_numpy())) for w, c in zip(of_whole, ("start", "length", "sequence", "offset"))
            )
            data = batch.column("ids")
            ids = np.frombuffer(data.buffers()[2], f"<u{width}") if len(rows) else np.empty(0, np.uint16)
            base = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(n)].astype(np.int64) // width
            for a, b in in_parts(size, IDS):
                at = rows[a:b]
                cut = ids[stretches(base[at] + start[a:b], size[a:b])].astype("<u4")
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(at)), pa.array(start[a:b]), pa.array(size[a:b]), binaries(cut, np.cumsum(size[a:b])),
                     pa.array(n[at]), pa.array(sequence[a:b]), pa.array(offset[a:b])],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return work


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 2, length: int = 4096, grain: int = 32,
) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` that hold every id of every row once.

    ``ids`` are little-endian 32-bit numbers.  A sequence is full, or as long as a power of two.
    """
    if length & (length - 1) or length % grain:
        raise ValueError("length is a power of two and a multiple of grain")
    spark = docs.sparkSession
    tokens = tokens_of(docs, doc_id, text, tokenizer or default_tokenizer(), end).withColumn("row", F.monotonically_increasing_id())
    # numbered as they are written; nothing is tokenized twice
    tokens = durable(tokens, "packing-ids", compression="zstd")
    items = tokens.select("row", "n", (F.col("n") % length).alias("size")).where("size > 0")
    items = items.withColumns({"class": F.ceil(F.col("size") / grain).cast("int"), "start": F.col("n") - F.col("size")})
    histogram = items.groupBy("class").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("ids")).orderBy("class").collect()
    classes, ids = [r["class"] for r in histogram], sum(r["ids"] for r in histogram)
    demand = np.array([r["items"] for r in histogram], np.int64)
    slots = Slots(classes, round_patterns(np.array(classes), demand, length // grain) if classes else [])
    kept, rest = divmod(ids, length)
    # the last ids, as powers of two
    short = [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]

    sequence = F.pandas_udf(lambda c, rank: pd.Series(slots.of(c.to_numpy(), rank.to_numpy())), "long")
    items = items.withColumn("lack", F.col("class") * grain - F.col("size")).drop("n")
    placed = ranked(items, ["class"], ["lack", "row"], "packing-ranks", size="members").withColumn("sequence", sequence("class", "rank"))
    placed = durable(placed.select("row", "start", "size", "sequence", "class", "rank"), "packing-slots")

    inside = Window.partitionBy("sequence").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stay = placed.where(F.col("sequence") < kept)
    pieces = stay.withColumn("offset", F.sum("size").over(inside) - F.col("size"))
    pieces = pieces.select("row", "start", F.col("size").alias("length"), "sequence", "offset")
    used = stay.groupBy("sequence").agg(F.sum("size").alias("offset"))
    gaps = used.select("sequence", (F.lit(length) - F.col("offset")).alias("gap"), "offset").where("gap > 0")
    last = spark.createDataFrame([(kept + i, s, 0) for i, s in enumerate(short)], "sequence long, gap long, offset long")
    apart = placed.where(F.col("sequence") >= kept).select("row", "start", "size")
    loose = apart.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    pieces = pieces.unionByName(pour(gaps.unionByName(last), apart, loose))
    cuts = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence", "offset"))).alias("cuts"))

    long = tokens.where(F.col("n") >= length).select("row", F.expr(f"n div {length}").alias("whole"))
    long = running_total(long, [], "row", {"full": F.col("whole")}, width=2000).select("row", (F.col("full") - F.col("whole")).alias("full"))
    cuts = durable(cuts.join(long, "row", "full"), "packing-cuts")
    forget(placed)
    meeting = tokens.join(cuts.hint("merge"), "row")
    kind = dict(tokens.dtypes)["doc_id"]
    return meeting.select("doc_id", "n", "width", "ids", "full", "cuts").mapInArrow(
        _cut(length, kept + len(short)),
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
