"""Token counts by heap-and-linked-list byte-pair merging.

The characters of a segment are a linked list of symbols.  A heap holds every adjacent pair
that is a piece of the vocabulary; the pair of lowest rank (then the leftmost) is popped and
merged until none is left.  The count is the number of initial symbols minus the merges; no
token identifiers are made.  A symbol that is no piece counts as its UTF-8 bytes.

A text is cut only where no piece can reach across (before a run of word marks, and at
characters that no longer piece contains), so segments merge as the whole text would.
Segments repeat, so each worker keeps the counts of the latest ones, at most ``MEMO``.

Whole texts are counted inside Arrow batches, one pass, no shuffle.  A NULL or empty text
has 0 tokens; columns of the input are kept and results are added under the names asked for.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The mark that stands for a space.
MARK = "▁"
#: Segments whose counts a worker keeps; when full, it starts again.
MEMO = 600_000


class PieceCounter:
    """Counts tokens of one vocabulary: ``ranks`` by piece, lower merges first."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.memo: dict[str, int] = {}
        longer = [p for p in ranks if len(p) > 1]
        inner = {c for p in longer for c in p}
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in longer)
        # line ends are the one frequent character that splits a word in two
        cut = "" if "\n" in inner else "\n"
        if crossing:
            self.segments = lambda text: [text] if text else []
        else:
            self.segments = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + ("|\n" if cut else "")).findall

    def _merged(self, segment: str) -> int:
        """Symbols left of one segment, bytes of unknown ones counted."""
        ranks = self.ranks
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] + symbols[i + 1])
            if rank is not None:
                heap.append((rank, i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, right, piece = heapq.heappop(heap)
            if symbols[left] is None or symbols[right] is None or after[left] != right:
                continue
            if symbols[left] + symbols[right] != piece:
                continue  # one side has grown since
            symbols[left], symbols[right] = piece, None
            merges += 1
            following = after[left] = after[right]
            if following < n:
                before[following] = left
                pair = piece + symbols[following]
                if (rank := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (rank, left, following, pair))
            previous = before[left]
            if previous >= 0:
                pair = symbols[previous] + piece
                if (rank := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (rank, previous, left, pair))
        unknown = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in ranks)
        return n - merges + unknown

    def count(self, text: str) -> int:
        if not text:
            return 0
        memo, total = self.memo, 0
        for segment in self.segments(MARK + text.replace(" ", MARK)):
            found = memo.get(segment)
            if found is None:
                found = self._merged(segment)
                if len(segment) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[segment] = found
            total += found
        return total


@cache
def counter(model: str) -> PieceCounter:
    """The counter of a sentencepiece model file; higher scores merge first."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    usable = [
        i for i in range(pieces.get_piece_size())
        if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))
    ]
    order = {s: k for k, s in enumerate(sorted({pieces.get_score(i) for i in usable}, reverse=True))}
    return PieceCounter({pieces.id_to_piece(i): order[pieces.get_score(i)] for i in usable})


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(
    docs: DataFrame, text: str = "text", model: str | None = None, limit: int = 4096,
    n_bytes: str = "n_bytes", n_tokens: str = "n_tokens", over: str = "over_limit",
) -> DataFrame:
    """``docs`` with the bytes and tokens of each text and whether it has more than ``limit`` tokens."""
    place = model or default_model()

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(place).count
        for texts in batches:
            yield pa.array([count(t.as_py() or "") for t in texts], pa.int64())

    counted = F.arrow_udf(counts, "long")
    return (
        docs.withColumn(n_bytes, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
        .withColumn(n_tokens, counted(F.col(text)))
        .withColumn(over, F.col(n_tokens) > limit)
    )
