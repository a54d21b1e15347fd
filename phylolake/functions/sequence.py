"""Sequence functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACDEFGHIKLMNPQRSTVWXY"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sanitise(col) -> Column:
    """Upper-cased sequence with the letters of the protein alphabet only."""
    return F.regexp_replace(F.upper(_c(col)), f"[^{ALPHABET}]", "")


def is_valid(col) -> Column:
    """The sequence is not empty and holds letters of the protein alphabet only."""
    return _c(col).rlike(f"^[{ALPHABET}]+$")


def kmers(col, k: int = 6) -> Column:
    """All overlapping words of length ``k``, with repeats; none for shorter sequences.

    Letters are joined with their shifted neighbours k - 1 times, so the work grows with the
    length of the sequence and not with its square, as cutting every word out of the text would.
    """
    c = _c(col)
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    words = letters
    for shift in range(1, k):
        words = F.zip_with(words, F.slice(letters, shift + 1, F.greatest(F.length(c), F.lit(1))), lambda a, b: F.concat(a, b))
    none = F.array().cast("array<string>")
    return F.when(F.length(c) >= k, F.slice(words, F.lit(1), F.greatest(F.length(c) - (k - 1), F.lit(0)))).otherwise(none)


def kmer_code(col, alphabet: str = ALPHABET) -> Column:
    """Number of a word in the base of the alphabet's size; null if it holds another letter."""
    c = _c(col)
    digits = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.instr(F.lit(alphabet), x) - 1)
    code = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * len(alphabet) + d)
    return F.when(c.rlike(f"^[{alphabet}]*$"), code)


def kmer_word(col, k: int, alphabet: str = ALPHABET) -> Column:
    """Inverse of :func:`kmer_code` for words of length ``k``."""
    n = len(alphabet)
    places = F.sequence(F.lit(k - 1), F.lit(0), F.lit(-1))
    return F.array_join(F.transform(places, lambda p: F.substring(F.lit(alphabet), (F.floor(_c(col) / F.pow(F.lit(float(n)), p)) % n + 1).cast("int"), F.lit(1))), "")


def gc_content(col) -> Column:
    """(G+C)/(A+C+G+T); 0 for a sequence without any of them."""
    c = F.upper(_c(col))
    gc, at = (F.length(F.regexp_replace(c, f"[^{x}]", "")) for x in ("GC", "AT"))
    return F.coalesce(F.try_divide(gc.cast("double"), (gc + at).cast("double")), F.lit(0.0))


def identity(a, b) -> Column:
    """Share of equal positions of two aligned strings where neither has a gap; 0 without any."""
    pairs = F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    both = F.filter(pairs, lambda p: (p["x"] != "-") & (p["y"] != "-") & (p["x"] != "") & (p["y"] != ""))
    return F.coalesce(F.try_divide(F.size(F.filter(both, lambda p: p["x"] == p["y"])).cast("double"), F.size(both).cast("double")), F.lit(0.0))


def md5(col) -> Column:
    return F.md5(_c(col))


def job_slot(col, n: int) -> Column:
    """Stable job number in [0, n) from the md5 of a key."""
    return F.pmod(F.conv(F.substring(F.md5(_c(col)), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")
