"""Longest-matching-block similarity of short texts, as Arrow UDFs.

Spark has no built-in for this ratio.  Only pairs that can still pass reach it,
and every call tries two cheap upper bounds first.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


@lru_cache(maxsize=200_000)
def ratio(a: str, b: str) -> float:
    """Similarity of two lower-cased texts; depends on the argument order."""
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=200_000)
def similar(a: str, b: str, threshold: float) -> bool:
    """``ratio(a, b) >= threshold``, skipping the exact ratio where bounds decide."""
    if a == b:
        return True
    total = len(a) + len(b)
    if total == 0 or 2.0 * min(len(a), len(b)) / total < threshold:
        return False
    matcher = SequenceMatcher(None, a, b)
    return matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold


_BINS = 64
#: Lists of candidates up to this length are tested one by one.
FEW = 16


def letter_counts(text: str) -> np.ndarray:
    """Characters of a text, folded into 64 bins: what two texts share is at most what their bins share."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % _BINS, minlength=_BINS)


def numbered_pairs(text: str) -> list[tuple[str, int]]:
    """Pairs of neighbouring characters, each with the number of its occurrence."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) - 1):
        pair = text[i : i + 2]
        seen[pair] = nth = seen.get(pair, -1) + 1
        out.append((pair, nth))
    return out


def pairs_needed(total: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs that two texts of ``total`` characters share at least where their ratio reaches ``threshold``.

    They match in m >= threshold * total / 2 characters.  The rest, total - 2m characters, parts the
    matching blocks, so there are total - 2m + 1 of them at most, and a block of n characters has n - 1 pairs.
    """
    matched = np.ceil(threshold * total / 2 - 1e-9)
    return 3 * matched - total - 1


class TitleIndex:
    """Titles by their pairs of characters, for all that may reach a ratio with a given one.

    An inverted list for each numbered pair counts the pairs that titles share with the given one; titles
    that share too few, or too few letters, can't reach the ratio.  No title that reaches it is left out.
    """

    def __init__(self) -> None:
        self.lists: dict[tuple[str, int], list[int]] = {}
        self.counts = np.zeros((64, _BINS), np.int32)
        self.lengths = np.zeros(64)
        self.size = 0

    def add(self, title: str) -> None:
        if self.size == len(self.lengths):
            self.counts = np.concatenate((self.counts, np.zeros_like(self.counts)))
            self.lengths = np.concatenate((self.lengths, np.zeros_like(self.lengths)))
        self.counts[self.size], self.lengths[self.size] = letter_counts(title), len(title)
        for pair in numbered_pairs(title):
            self.lists.setdefault(pair, []).append(self.size)
        self.size += 1

    def _by_letters(self, title: str, numbers: np.ndarray, threshold: float) -> np.ndarray:
        shared = np.minimum(self.counts[numbers], letter_counts(title)).sum(axis=1)
        return numbers[2.0 * shared >= (threshold - 1e-9) * (self.lengths[numbers] + len(title))]

    def possible(self, title: str, threshold: float, among: np.ndarray | None = None) -> np.ndarray:
        """Ascending numbers of the titles (of those ``among``) whose ratio with ``title`` may reach ``threshold``."""
        numbers = np.arange(self.size) if among is None else among
        needed = pairs_needed(self.lengths[numbers] + len(title), threshold)
        if (needed > 0).any():
            found = [entry for pair in numbered_pairs(title) for entry in self.lists.get(pair, ())]
            shared = np.bincount(np.array(found, np.int64), minlength=self.size)[numbers]
            numbers = numbers[shared >= needed]
        return self._by_letters(title, numbers, threshold)


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [ratio(x.lower(), y.lower()) if x is not None and y is not None else None
         for x, y in zip(a, b)],
        dtype="float64",
    )


def is_similar(threshold: float):
    """UDF (a, b) -> whether their ratio reaches ``threshold``."""

    @F.pandas_udf(T.BooleanType())
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x.lower(), y.lower(), threshold) for x, y in zip(a, b)])

    return check


def resembles_any(threshold: float):
    """UDF (text, candidates) -> whether some candidate reaches ``threshold``.

    Many candidates are indexed; texts that meet the same ones share the index.
    """

    @F.pandas_udf(T.BooleanType())
    def check(text: pd.Series, candidates: pd.Series) -> pd.Series:
        known: dict[tuple[str, ...], TitleIndex] = {}

        def one(t: str, found) -> bool:
            if len(found) <= FEW:
                return any(similar(t, c, threshold) for c in found)
            key = tuple(found)
            if key not in known:
                known[key] = TitleIndex()
                for c in key:
                    known[key].add(c)
            return any(similar(t, key[i], threshold) for i in known[key].possible(t, threshold))

        return pd.Series([one(t, found) for t, found in zip(text, candidates)], dtype="boolean")

    return check
