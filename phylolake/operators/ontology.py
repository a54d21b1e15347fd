"""Ontology terms: closure, depth, frequency, information content, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Evidence codes of experiments, those that also count as such from high-throughput work, and
# references of reviewed electronic annotation.
EXPERIMENTAL = ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP")
HIGH_THROUGHPUT = ("HTP", "HDA", "HMP", "HGI", "HEP")
TRUSTED_ELECTRONIC_REFS = (
    "GO_REF:0000002", "GOA:interpro", "GOA:interpro|GO_REF:0000002", "GO_REF:0000003", "GOA:spec", "GOA:spec|GO_REF:0000003", "GO_REF:0000004", "GOA:spkw",
    "GOA:spkw|GO_REF:0000004", "GO_REF:0000037", "GO_REF:0000038", "GO_REF:0000023", "GOA:spsl", "GOA:spsl|GO_REF:0000023", "GO_REF:0000039", "GO_REF:0000040",
)
ASPECTS = {"biological_process": "P", "molecular_function": "F", "cellular_component": "C"}


def term_number(col) -> Column:
    """Number of a term given as integer text or ``GO:`` and up to seven digits; null if it is neither."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    return F.nullif(F.regexp_extract(c, r"^(?:GO:)?([0-9]{1,7})$", 1), F.lit("")).try_cast("bigint")


def term_id(col) -> Column:
    return F.format_string("GO:%07d", (F.col(col) if isinstance(col, str) else col).cast("bigint"))


def aspect_letter(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ASPECTS.items() for x in kv]), c)


def superterms(go_closure: DataFrame, terms: DataFrame, *, max_steps: int | None = None) -> DataFrame:
    """(term_nr, ancestor, dist) of the given terms, themselves included."""
    out = go_closure.join(terms.select(F.col("term_nr").alias("descendant")).distinct(), "descendant")
    out = out if max_steps is None else out.where(F.col("dist") <= max_steps)
    return out.select(F.col("descendant").alias("term_nr"), "ancestor", "dist")


def subterms(go_closure: DataFrame, terms: DataFrame, *, max_steps: int | None = None) -> DataFrame:
    """(term_nr, descendant, dist) of the given terms, themselves included."""
    out = go_closure.join(terms.select(F.col("term_nr").alias("ancestor")).distinct(), "ancestor")
    out = out if max_steps is None else out.where(F.col("dist") <= max_steps)
    return out.select(F.col("ancestor").alias("term_nr"), "descendant", "dist")


def min_depths(go_closure: DataFrame, edges: DataFrame) -> DataFrame:
    """(term_nr, depth): shortest distance to any root."""
    rooted = go_closure.join(edges.select(F.col("child").alias("ancestor")), "ancestor", "left_anti")
    return rooted.groupBy(F.col("descendant").alias("term_nr")).agg(F.min("dist").alias("depth"))


def term_frequencies(annotations: DataFrame, go_closure: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_nr, aspect, n, total, freq): distinct annotated entries of each term and its descendants over the aspect's total.

    Each distinct (entry, term) adds one to the term and to all its ancestors; the
    total of an aspect is what its most general term (or, with several roots, all
    annotations of the aspect) collected. Annotations are first counted per term, so
    the closure is applied to terms and not to annotations.
    """
    per_term = annotations.select("entry_nr", "term_nr").distinct().join(terms.select("term_nr", "aspect"), "term_nr").groupBy("term_nr", "aspect").agg(F.count(F.lit(1)).alias("k"))
    total = per_term.groupBy("aspect").agg(F.sum("k").alias("total"))
    up = per_term.join(go_closure.select(F.col("descendant").alias("term_nr"), "ancestor"), "term_nr")
    n = up.groupBy(F.col("ancestor").alias("term_nr")).agg(F.sum("k").alias("n"))
    return terms.select("term_nr", "aspect").join(n, "term_nr", "left").join(F.broadcast(total), "aspect", "left").select(
        "term_nr", "aspect", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("freq"),
    )


def information_content(freq: Column) -> Column:
    """|ln(freq)|; null for a term that never occurs."""
    return F.when(freq > 0, F.abs(F.ln(freq)))


def pair_similarity(pairs: DataFrame, go_closure: DataFrame, freq: DataFrame) -> DataFrame:
    """(t1, t2, lca, lin, similarity) of term pairs.

    The lowest common ancestor is the common ancestor of least frequency (ties: smaller
    number). lin = 2 ln f(lca) / (ln f1 + ln f2); the similarity is (1 - f(lca)) lin, 0 for
    terms of different aspects or without a common ancestor. A term that never
    occurs has no similarity (null); two terms of frequency 1 have lin 1.
    """
    f = freq.select("term_nr", "aspect", "freq")
    up = go_closure.select("descendant", "ancestor")
    a = pairs.join(up.toDF("t1", "ancestor"), "t1")
    common = a.join(up.toDF("t2", "ancestor"), ["t2", "ancestor"]).join(f.select(F.col("term_nr").alias("ancestor"), F.col("freq").alias("fa")), "ancestor")
    lca = common.groupBy("t1", "t2").agg(F.min(F.struct("fa", "ancestor")).alias("b")).select("t1", "t2", F.col("b.ancestor").alias("lca"), F.col("b.fa").alias("fa"))
    sides = pairs.join(f.toDF("t1", "a1", "f1"), "t1").join(f.toDF("t2", "a2", "f2"), "t2").join(lca, ["t1", "t2"], "left")
    denominator = F.ln("f1") + F.ln("f2")
    lin = F.when((F.col("f1") <= 0) | (F.col("f2") <= 0), F.lit(None)).when(denominator == 0, F.lit(1.0)).otherwise(2 * F.ln("fa") / denominator)
    lin = F.when((F.col("a1") != F.col("a2")) | F.col("lca").isNull(), F.lit(0.0)).otherwise(lin)
    return sides.select("t1", "t2", "lca", lin.alias("lin"), (F.when(F.col("lca").isNull() | (F.col("a1") != F.col("a2")), F.lit(0.0)).otherwise((1 - F.col("fa")) * lin)).alias("similarity"))


def most_specific(annotations: DataFrame, go_closure: DataFrame, *, by: str = "entry_nr") -> DataFrame:
    """Annotations without those implied by a more specific term of the same entry."""
    a = annotations.select(by, "term_nr").distinct()
    implied = a.join(go_closure.where("dist > 0").select(F.col("descendant").alias("term_nr"), "ancestor"), "term_nr").select(by, F.col("ancestor").alias("term_nr")).distinct()
    return a.join(implied, [by, "term_nr"], "left_anti")


def is_experimental(evidence: Column) -> Column:
    return evidence.isin(*EXPERIMENTAL)


def is_trusted(evidence: Column, reference: Column) -> Column:
    """Experimental, or electronic from a reviewed pipeline."""
    return is_experimental(evidence) | ((evidence == "IEA") & reference.isin(*TRUSTED_ELECTRONIC_REFS))


def not_negated(qualifier: Column) -> Column:
    return ~F.coalesce(F.upper(qualifier), F.lit("")).contains("NOT")
