"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylolake.llm.abuse import abuse_scores
from phylolake.llm.components import connected_groups
from phylolake.llm.leakage import leaked_passages, removal_spans
from phylolake.llm.mixture import mix_sources, source_key
from phylolake.llm.set_pairs import similar_set_pairs
from phylolake.llm.term_frequency import marked_frequency
from phylolake.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of family profiles whose species sets have a Jaccard index of at least 0.7."""
    pairs = similar_set_pairs(table(spark, sf, "hog_profile"), id_col="ProfileId", items_col="species_profile", absent=(-1,), threshold=0.7)
    return pairs.select(F.col("id1").alias("profile_id1"), F.col("id2").alias("profile_id2"))


P1_FOUND = """
WITH s AS (SELECT DISTINCT ProfileId AS p, unnest(species_profile) AS x FROM hog_profile),
c AS (SELECT p, x FROM s WHERE x IS NOT NULL AND x <> -1),
n AS (SELECT p, count(*) AS k FROM c GROUP BY p),
i AS (SELECT a.p AS p1, b.p AS p2, count(*) AS k FROM c a JOIN c b ON a.x = b.x AND a.p < b.p GROUP BY a.p, b.p)
SELECT i.p1 AS profile_id1, i.p2 AS profile_id2 FROM i JOIN n n1 ON n1.p = i.p1 JOIN n n2 ON n2.p = i.p2
WHERE i.k * 10 >= 7 * (n1.k + n2.k - i.k)"""


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The group (smallest entry reachable) of every entry with an orthology link."""
    links = table(spark, sf, "pairwise").where("RelType BETWEEN 0 AND 3 AND EntryNr1 <> 0 AND EntryNr2 <> 0")
    return connected_groups(links, "EntryNr1", "EntryNr2").select(F.col("vertex").alias("entry_nr"), F.col("group").alias("group_nr"))


P2_FOUND = """
WITH RECURSIVE l AS (SELECT EntryNr1 AS x, EntryNr2 AS y FROM pairwise WHERE RelType BETWEEN 0 AND 3 AND EntryNr1 <> 0 AND EntryNr2 <> 0 AND EntryNr1 <> EntryNr2),
b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
c AS (SELECT DISTINCT x AS v, x AS r FROM b UNION SELECT c.v, b.y FROM c JOIN b ON b.x = c.r)
SELECT v AS entry_nr, min(r) AS group_nr FROM c GROUP BY 1"""


def p3_term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences, annotated entries and mark of every term used."""
    marked = marked_frequency(table(spark, sf, "go_annotation"), "TermNr", "EntryNr", absent=(0,))
    return marked.select(F.col("term").alias("term_nr"), "occurrences", F.col("records").alias("entries"), "mark")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return p3_term_frequency(spark, sf).where("mark IS NOT NULL").select("term_nr", "mark")


P3_TERM_FREQUENCY = """
WITH r AS (SELECT TermNr AS t, EntryNr AS e FROM go_annotation WHERE TermNr <> 0 AND EntryNr <> 0),
n AS (SELECT count(DISTINCT e) AS n FROM r)
SELECT t AS term_nr, count(*) AS occurrences, count(DISTINCT e) AS entries,
  CASE WHEN count(DISTINCT e) <= 2 THEN 'rare' WHEN count(DISTINCT e) * 100 > 5 * (SELECT n FROM n) THEN 'common' END AS mark
FROM r GROUP BY t"""
P3_FOUND = f"SELECT term_nr, mark FROM ({P3_TERM_FREQUENCY}) WHERE mark IS NOT NULL"

def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_passages(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_item"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least 20 running words of a held-out passage, with the items."""
    return p7_leaks(spark, sf).select("doc_id", "item_id").distinct()


def p7_removal_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Merged word spans to remove from each document."""
    return removal_spans(p7_leaks(spark, sf))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """How often every document is used in the mixture."""
    m = mix_sources(table(spark, sf, "documents"), table(spark, sf, "source_target"))
    return m.records.select(F.col("id").alias("doc_id"), "source", "n_tokens", "repeats")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of the tokens of every source."""
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "source_target")).shares


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every document; from 0.5 on with the kind of language."""
    return abuse_scores(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "review_label"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return p9_scores(spark, sf).where("score >= 0.5").select("doc_id")


def p9_source_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of such documents per source (null: documents without a source)."""
    scored = p9_scores(spark, sf)
    own = table(spark, sf, "documents").select("doc_id", source_key("source").alias("source"))
    flag = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return (
        own.join(scored, "doc_id").groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(flag).alias("n_flagged"), F.round(F.avg(flag), 6).alias("rate"))
    )


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_term_frequency": p3_term_frequency, "p7_found": p7_found, "p7_removal_spans": p7_removal_spans,
    "p8_mixture": p8_mixture, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_scores": p9_scores, "p9_source_rates": p9_source_rates}
ORACLE = {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_term_frequency": P3_TERM_FREQUENCY}
