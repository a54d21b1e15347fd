"""Over-representation of terms in a study set: one-sided Fisher test and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylolake.operators.ontology import most_specific
from phylolake.session import work_slots


def log_factorial(n: Column) -> Column:
    """ln(n!) of a whole number from 0 on: the Stirling series of the log-gamma function at n + 9, brought down by the product of the
    eight factors between; relative errors stay below 1e-13."""
    z = n.cast("double") + 9.0
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    product = F.lit(1.0)
    for k in range(1, 9):
        product = product * (n.cast("double") + float(k))
    return series - F.ln(product)


def hypergeometric_tail(counts: DataFrame) -> DataFrame:
    """``counts`` (term_nr, a, n, k, total) with p = P(X >= a) for n draws, k hits among ``total``.

    Equal (a, n, k, total) are computed once. The first term of the sum comes from log factorials, every further one by the ratio of
    neighbouring terms, within one row: no table of factorials, no exploded terms, no join.
    """
    cases = counts.select("a", "n", "k", "total").distinct().repartition(work_slots(counts.sparkSession))
    a, n, k, total = (F.col(c).cast("double") for c in ("a", "n", "k", "total"))
    low = F.greatest(F.col("a"), F.col("n") + F.col("k") - F.col("total"), F.lit(0)).cast("bigint")
    high = F.least("n", "k")

    def choose(x, y):
        return log_factorial(x) - log_factorial(y) - log_factorial(x - y)

    first = choose(F.col("k"), F.col("low")) + choose(F.col("total") - F.col("k"), F.col("n") - F.col("low")) - choose(F.col("total"), F.col("n"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc, x):
        x = x.cast("double")
        term = acc["term"] * ((k - x) * (n - x)) / ((x + 1) * (total - k - n + x + 1))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(F.col("high") > F.col("low"), F.sequence("low", F.col("high") - 1)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, start, add)["sum"]
    sized = cases.withColumn("low", low).withColumn("high", high.cast("bigint"))
    p = F.when(F.col("low") > F.col("high"), 0.0).when(F.col("low") <= F.greatest(F.lit(0), F.col("n") + F.col("k") - F.col("total")), 1.0).otherwise(F.least(F.exp(first) * tail, F.lit(1.0)))
    return counts.join(sized.select("a", "n", "k", "total", p.alias("p")), ["a", "n", "k", "total"])


def corrected(tests: DataFrame, p: str = "p") -> DataFrame:
    """Adds p_bonferroni and p_fdr (Benjamini-Hochberg); one row per tested term."""
    m = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.count(F.lit(1)).over(Window.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    raw = tests.withColumn("p_bonferroni", F.least(F.col(p) * m, F.lit(1.0))).withColumn("__q", F.col(p) * m / rank)
    return raw.withColumn("p_fdr", F.least(F.min("__q").over(Window.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("__q")


def enrichment(annotations: DataFrame, study: DataFrame, go_closure: DataFrame, *, by: str = "entry_nr", population: DataFrame | None = None, alpha: float | None = None) -> DataFrame:
    """Terms over-represented among the study entries against the population.

    (term_nr, study_count, study_n, pop_count, pop_n, fold_change, p, p_bonferroni, p_fdr), for
    terms of the study. Annotations are reduced to the most specific ones, then
    spread to all ancestors that occur in the population's vocabulary. The
    population defaults to all annotated entries; study entries outside it are
    ignored. ``alpha`` keeps results with p_fdr below it.
    """
    pop = (population if population is not None else annotations).select(by).distinct()
    a = annotations.select(by, "term_nr").distinct().join(pop, by, "left_semi")
    vocabulary = a.select(F.col("term_nr").alias("ancestor")).distinct()
    spread = most_specific(a, go_closure, by=by).join(go_closure.select(F.col("descendant").alias("term_nr"), "ancestor"), "term_nr").join(vocabulary, "ancestor", "left_semi")
    spread = spread.select(by, F.col("ancestor").alias("term_nr")).distinct()
    chosen = study.select(by).distinct().join(pop, by, "left_semi").withColumn("__in", F.lit(1))
    counts = spread.join(chosen, by, "left").groupBy("term_nr").agg(F.count("__in").alias("a"), F.count(F.lit(1)).alias("k")).where("a > 0")
    n_study, n_pop = chosen.count(), pop.count()
    counted = counts.withColumn("n", F.lit(n_study).cast("bigint")).withColumn("total", F.lit(n_pop).cast("bigint"))
    fold = (F.col("a") / F.col("n")) / (F.col("k") / F.col("total"))
    out = corrected(hypergeometric_tail(counted)).select(
        "term_nr", F.col("a").alias("study_count"), F.col("n").alias("study_n"), F.col("k").alias("pop_count"), F.col("total").alias("pop_n"), fold.alias("fold_change"), "p", "p_bonferroni", "p_fdr"
    )
    return out if alpha is None else out.where(F.col("p_fdr") < alpha)


def term_layout(terms: DataFrame, go_closure: DataFrame, freq: DataFrame, *, dimensions: int = 2) -> DataFrame:
    """(aspect, term_nr, x0, x1): terms placed by 10 (1 - similarity), one layout per aspect.

    For result lists of an enrichment (hundreds of terms); all pairs of an aspect are compared.
    """
    from phylolake.operators.ontology import pair_similarity
    from phylolake.operators.similarity import mds_layout

    known = terms.select("term_nr").distinct().join(freq.select("term_nr", "aspect"), "term_nr")
    a, b = known.toDF("t1", "aspect"), known.toDF("t2", "aspect")
    pairs = a.join(b, "aspect").where("t1 < t2")
    scored = pair_similarity(pairs.select("t1", "t2"), go_closure, freq).join(pairs, ["t1", "t2"])
    d = scored.withColumn("d", 10 * (1 - F.coalesce("similarity", F.lit(0.0))))
    return mds_layout(d, known, group="aspect", node="term_nr", a="t1", b="t2", distance="d", dimensions=dimensions, missing=10.0).withColumnRenamed("g", "aspect").withColumnRenamed("node", "term_nr")
