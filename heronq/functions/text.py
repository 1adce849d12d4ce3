"""Words, runs of words and sets of them, in built-in functions. Words are runs outside 0x20 and 0x09-0x0D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _CAPITALS, _SMALL)


def words(text: Column) -> Column:
    """All words of a text in order; none of a null text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def run_hashes(words: Column, hashes: Column, n: int) -> Column:
    """A 64-bit hash of the n words from each position. `hashes` are those of the words, as a column of its own."""
    run = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), run)).otherwise(F.array().cast("array<bigint>"))


def run_text(words: Column, at: Column, n: int) -> Column:
    """The n words from position `at` (0 is the first), joined by a space."""
    return F.concat_ws(" ", *[F.get(words, at + k) for k in range(n)])
