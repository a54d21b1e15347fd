"""Hierarchical-group identifiers as Column expressions (no Python workers).

An id reads ``HOG:<release letters><family, zero padded>(.<number><letters>)*``
and may carry a trailing ``_<taxid>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILY_PATTERN = r"^\s*HOG:[A-Za-z]*0*([0-9]+)"
TAXID_SUFFIX = r"_-?[0-9]+$"
ID_PATTERN = r"^HOG:([A-Za-z]*)0*([0-9]+)((?:\.[0-9]+[a-z]+)*)$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def family_nr(col) -> Column:
    """Family number of an id in any spelling; null for null, empty or malformed ids."""
    return F.regexp_extract(_c(col), FAMILY_PATTERN, 1).try_cast("bigint")


def strict_family_nr(col) -> Column:
    """Family number; a non-empty malformed id raises when the plan runs."""
    c = _c(col)
    fam = family_nr(c)
    bad = c.isNotNull() & (F.trim(c) != "") & fam.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("not a group id: "), c)).cast("bigint")).otherwise(fam)


def release_letters(col) -> Column:
    """Letters between ``HOG:`` and the family number; '' when there are none."""
    return F.coalesce(F.regexp_extract(F.trim(_c(col)), ID_PATTERN, 1), F.lit(""))


def plain_id(col) -> Column:
    """Canonical spelling: trimmed, without taxid suffix, family number without padding; '' for none."""
    c = F.regexp_replace(F.trim(F.coalesce(_c(col), F.lit(""))), TAXID_SUFFIX, "")
    return F.regexp_replace(c, r"^(HOG:[A-Za-z]*)0+(?=[0-9])", "$1")


def format_id(fam, letters: str = "") -> Column:
    """``HOG:<letters>`` and the family number padded to seven digits."""
    return F.format_string(f"HOG:{letters}%07d", _c(fam).cast("bigint"))


def tokens(col) -> Column:
    """Dot-separated parts of an id."""
    return F.split(_c(col), r"\.")


def ancestor_ids(col) -> Column:
    """The id and the ids of all its ancestors, root first; an empty array for none."""
    t = tokens(col)
    c = _c(col)
    return F.when(
        c.isNotNull() & (c != ""),
        F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: F.array_join(F.slice(t, F.lit(1), i), ".")),
    ).otherwise(F.array().cast("array<string>"))


def depth(col) -> Column:
    """Number of duplication steps below the family root."""
    return F.size(tokens(col)) - 1


def within(col, prefix: str) -> Column:
    """The id equals ``prefix`` or lies below it (token boundary respected)."""
    c = _c(col)
    return (c == prefix) | c.startswith(prefix + ".")


def lexicographic_range(prefix: str) -> tuple[str, str]:
    """Half-open byte range of the strings that start with ``prefix``."""
    return prefix, prefix[:-1] + chr(ord(prefix[-1]) + 1)


def _first_difference(h1: Column, h2: Column) -> tuple[Column, Column, Column]:
    t1, t2 = tokens(h1), tokens(h2)
    n = F.least(F.size(t1), F.size(t2))
    at = F.coalesce(
        F.try_element_at(F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(t1, i) != F.element_at(t2, i)), F.lit(1)),
        F.lit(0),
    )
    return t1, t2, at


def are_orthologous(h1, h2) -> Column:
    """Whether two members' ids stand for a speciation.

    Both ids must share the family. The first differing token decides: another
    number is a speciation, the same number with other letters a duplication.
    Ids of which one contains the other are orthologous. Null if an id is null.
    """
    h1, h2 = _c(h1), _c(h2)
    t1, t2, at = _first_difference(h1, h2)
    nr = lambda t: F.regexp_extract(F.try_element_at(t, at), r"^([0-9]+)", 1)
    return F.when(h1.isNull() | h2.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.when((h1 == "") | (h2 == ""), F.lit(False)).when(at == 1, F.lit(False)).when(at == 0, F.lit(True)).otherwise(nr(t1) != nr(t2))
    )


def common_group(h1, h2) -> Column:
    """Deepest id that contains both members; '' for different families."""
    h1, h2 = _c(h1), _c(h2)
    t1, t2, at = _first_difference(h1, h2)
    keep = F.when(at == 0, F.least(F.size(t1), F.size(t2))).otherwise(at - 1)
    return F.when(keep > 0, F.array_join(F.slice(t1, F.lit(1), keep), ".")).otherwise(F.lit(""))


def common_prefix(a, b) -> Column:
    """Longest common character prefix of two strings."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    first = F.try_element_at(
        F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), F.lit(1)
    )
    return F.substring(a, F.lit(1), F.coalesce(first - 1, n))


def character_paralogs(h1, h2) -> Column:
    """Older character-based test: the common prefix holds a dot and ends in a digit."""
    p = common_prefix(h1, h2)
    return p.contains(".") & p.rlike(r"[0-9]$")
