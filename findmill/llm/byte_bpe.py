"""Byte-level BPE encoding and decoding with the tokenizers library.

The byte-to-character table maps every byte to a printable character; the library merges
those characters by the ranks of a rank file, inside each match of the split pattern.
Decoding looks up the bytes of each id and joins them, so characters that are split over
several ids come back whole; ``text_pieces`` decodes a stream of ids with an incremental
decoder that holds back the bytes of an unfinished character.

Whole texts, one pass over Arrow batches, no shuffle.  A NULL or empty text has no ids.
Columns of the input are kept; results are added under the names asked for.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from findmill.llm.tables import release_memory, unused


def byte_table() -> list[str]:
    """The character of each byte: itself if it is printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(printable))
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that ``token`` is made of last: merge by rank as long as the rank is below its own."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[best] + parts[best + 1], own) >= own:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    if len(parts) != 2:
        raise ValueError(f"no merge makes {token!r}")
    return parts[0], parts[1]


class ByteBpe:
    """One vocabulary: a tokenizer of the library and the byte strings of its ids."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        table = byte_table()
        as_text = lambda token: "".join(table[b] for b in token)
        ordered = sorted(ranks, key=ranks.get)
        merges = [tuple(map(as_text, _merge_of(t, ranks))) for t in ordered if len(t) > 1]
        self.tokenizer = Tokenizer(models.BPE({as_text(t): ranks[t] for t in ordered}, merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        back = {c: b for b, c in enumerate(table)}
        size = max(ranks.values()) + 1
        self.bytes = [b""] * size
        for text, number in self.tokenizer.get_vocab().items():
            self.bytes[number] = bytes(back[c] for c in text)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        # a few texts at a time: the library's results are larger than the texts
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) < 1 << 17):
                size += len(texts[end])
                end += 1
            for encoded in self.tokenizer.encode_batch_fast(texts[start:end], add_special_tokens=False):
                yield np.array(encoded.ids, np.uint32)
            start = end

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """The span of characters of each token; tokens inside one character share its span."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def text_pieces(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of a stream of ids, chunk by chunk; a character split between chunks comes with the later one."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in chunks:
            yield decoder.decode(self.decode(ids))
        yield decoder.decode(b"", True)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@cache
def vocabulary(path: str, pattern: str) -> ByteBpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(path, pattern)


def encode_texts(
    docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, ids: str = "ids",
) -> DataFrame:
    """``docs`` with the ids of each text as little-endian unsigned 32-bit integers."""
    place, split = (path, pattern) if path else default_vocabulary()

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = vocabulary(place, split).encode
        for texts in batches:
            found = encode([t or "" for t in texts.to_pylist()])
            yield pa.array([i.astype("<u4").tobytes() for i in found], pa.binary())

    return docs.withColumn(ids, F.arrow_udf(encoded, "binary")(F.col(text)))


def decode_ids(
    rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None, decoded: str = "decoded",
) -> DataFrame:
    """``rows`` with the bytes that each row's ids stand for; NULL ids decode to no bytes."""
    place, split = (path, pattern) if path else default_vocabulary()

    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = vocabulary(place, split).decode
        for blobs in batches:
            yield pa.array([decode(np.frombuffer(b or b"", "<u4").tolist()) for b in blobs.to_pylist()], pa.binary())

    return rows.withColumn(decoded, F.arrow_udf(bytes_of, "binary")(F.col(ids)))


def round_trip(
    docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, ids: str = "ids", decoded: str = "decoded",
) -> DataFrame:
    """``docs`` with the ids of each text and the bytes they decode to, by one worker instead of two."""
    place, split = (path, pattern) if path else default_vocabulary()
    kind = pa.struct([(ids, pa.binary()), (decoded, pa.binary())])

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(place, split)
        for texts in batches:
            found = list(bpe.encode([t or "" for t in texts.to_pylist()]))
            blobs = [i.astype("<u4").tobytes() for i in found], [bpe.decode(i.tolist()) for i in found]
            yield pa.StructArray.from_arrays([pa.array(b, pa.binary()) for b in blobs], fields=list(kind))
            del found, blobs
        release_memory()

    pair = unused(docs, "both")
    made = docs.withColumn(pair, F.arrow_udf(both, f"`{ids}` binary, `{decoded}` binary")(F.col(text)))
    return made.withColumns({ids: F.col(pair)[ids], decoded: F.col(pair)[decoded]}).drop(pair)
