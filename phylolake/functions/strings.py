"""String, date and locus functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of a strain inside a scientific name; in names of one species an O does as well.
STRAIN_MARKERS = ("(", "serogroup", "serotype", "serovar", "biotype", "subsp", "pv.", "bv.")
STRAIN_O_SPECIES = "Escherichia coli"
# Date formats of release files.
DATE_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "dd.MM.yyyy", "yyyyMMdd", "yyyy-MM-dd", "dd-MM-yyyy", "dd-MMM-yyyy")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def snake_case(col) -> Column:
    """CamelCase to snake_case."""
    c = F.regexp_replace(_c(col), r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"))


def without_version(col) -> Column:
    """Identifier without a version suffix of one or two digits."""
    return F.regexp_replace(_c(col), r"\.[0-9]{1,2}$", "")


def id_list(col) -> Column:
    """Identifiers of a '; ' separated list, repeat markers dropped or cut off."""
    parts = F.transform(F.split(_c(col), r";\s*"), lambda x: F.regexp_replace(F.trim(x), r"\.Rep[0-9]*$", ""))
    return F.filter(parts, lambda x: (x != "") & ~x.startswith("Rep"))


def before_species_suffix(col) -> Column:
    return F.substring_index(_c(col), "_", 1)


def _strain_start(c: Column) -> Column:
    """Position of the first strain mark (from 1); one past the end if there is none."""
    end = F.length(c) + 1
    at = [F.instr(c, m) for m in STRAIN_MARKERS] + [F.when(c.startswith(STRAIN_O_SPECIES), F.instr(c, "O")).otherwise(0)]
    return F.least(end, *[F.when(a > 0, a) for a in at])


def species_part(col) -> Column:
    """Scientific name up to the first strain mark."""
    c = _c(col)
    return F.trim(F.substring(c, F.lit(1), _strain_start(c) - 1))


def strain_part(col) -> Column:
    c = _c(col)
    return F.substring(c, _strain_start(c), F.length(c))


def newick_label(col) -> Column:
    return F.translate(_c(col), " ()", "_[]")


def protein_id(code, nr) -> Column:
    """Species code and the local number padded to five digits."""
    return F.format_string("%s%05d", _c(code), _c(nr).cast("bigint"))


def protein_id_parts(col) -> tuple[Column, Column]:
    """(code, local number) of such an id; nulls if it is none."""
    c = F.upper(F.trim(_c(col)))
    code = F.nullif(F.regexp_extract(c, r"^([A-Z][A-Z0-9]{4})[0-9]{5,}$", 1), F.lit(""))
    nr = F.nullif(F.regexp_extract(c, r"^[A-Z][A-Z0-9]{4}([0-9]{5,})$", 1), F.lit("")).try_cast("bigint")
    return code, nr


def any_date(col) -> Column:
    """Date in any of the accepted formats; null if none fits."""
    return F.coalesce(*[F.try_to_timestamp(_c(col), F.lit(f)) for f in DATE_FORMATS]).cast("date")


# -- loci -------------------------------------------------------------------------------


def exons(col) -> Column:
    """Exons of a locus text as array<struct<start, end, strand>>.

    Understands ``a..b``, ``join(...)``, ``complement(...)``, ``Before(n)``, ``After(n)`` and
    ``FromElsewhere('..', a..b)``; single positions count as one-base exons. Null or
    unreadable text gives an empty array.
    """
    c = F.coalesce(_c(col), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(c, r"(?:Before|After)\(\s*([0-9]+)\s*\)", "$1"), r"FromElsewhere\('[^']*',\s*([^)]*)\)", "$1")
    whole = plain.rlike(r"^\s*complement\s*\(\s*join")
    parts = F.regexp_extract_all(plain, F.lit(r"((?:complement\s*\(\s*(?:join\s*\(\s*)?)?[0-9]+(?:\.\.[0-9]+)?)"), F.lit(1))

    def one(p):
        start = F.regexp_extract(p, r"([0-9]+)", 1).cast("bigint")
        end = F.coalesce(F.nullif(F.regexp_extract(p, r"\.\.([0-9]+)", 1), F.lit("")).cast("bigint"), start)
        return F.struct(start.alias("start"), end.alias("end"), F.when(whole | p.contains("complement"), -1).otherwise(1).alias("strand"))

    return F.transform(parts, one)


def locus_text(exon_array) -> Column:
    """Text of an exon array; minus-strand exons are written as complements, the last one first."""
    a = _c(exon_array)
    minus = F.exists(a, lambda e: e["strand"] < 0)
    up = F.array_sort(F.transform(a, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["strand"].alias("strand"))))
    ordered = F.when(minus, F.reverse(up)).otherwise(up)
    span = lambda e: F.concat(e["start"], F.lit(".."), e["end"])
    texts = F.transform(ordered, lambda e: F.when(e["strand"] < 0, F.concat(F.lit("complement("), span(e), F.lit(")"))).otherwise(span(e)))
    return F.when(F.size(texts) > 1, F.concat(F.lit("join("), F.array_join(texts, ", "), F.lit(")"))).otherwise(F.array_join(texts, ", "))
