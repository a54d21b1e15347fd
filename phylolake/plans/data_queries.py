"""Queries of the general data operators: dominant keys, orphan references, snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylolake.functions import hogid
from phylolake.operators import orphans, skew, snapshots
from phylolake.session import discard, spill, table

DOMINANT_PERCENT = 3
#: A key is heavy from one in HEAVY_FRACTION of all references on: at most that many keys are broadcast.
HEAVY_FRACTION = 2000


def _family_of_entry(e: DataFrame) -> DataFrame:
    return e.withColumn("fam", hogid.family_nr("OmaHOG"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Families with at least 3 percent of the rows of entry or of hog_level."""
    e = _family_of_entry(table(spark, sf, "entry").select("OmaHOG")).select("fam")
    h = table(spark, sf, "hog_level").select(F.col("Fam").cast("bigint").alias("fam"))
    parts = [
        skew.dominant_keys(df, "fam", DOMINANT_PERCENT).select(F.lit(tab).alias("tab"), "fam") for tab, df in (("entry", e), ("hog_level", h))
    ]
    return parts[0].unionByName(parts[1])


P4_FOUND = """
WITH f AS (
  SELECT 'entry' AS tab, try_cast(nullif(regexp_extract(OmaHOG, '^\\s*HOG:[A-Za-z]*0*([0-9]+)', 1), '') AS BIGINT) AS fam FROM entry
  UNION ALL SELECT 'hog_level', CAST(Fam AS BIGINT) FROM hog_level),
t AS (SELECT tab, count(*) AS n FROM f GROUP BY tab)
SELECT f.tab, f.fam FROM f JOIN t ON f.tab = t.tab WHERE f.fam IS NOT NULL
GROUP BY f.tab, f.fam, t.n HAVING count(*) * 100 >= 3 * t.n"""


def p4_family_results(spark: SparkSession, sf: str) -> DataFrame:
    """Per-family results of every family: rows, rows in a flat group, first and last release, genomic span."""
    e = _family_of_entry(table(spark, sf, "entry"))
    return skew.tree_aggregate(
        e.select("fam", "ReleaseNr", "LocusStart", "LocusEnd", F.when(F.col("OmaGroup") > 0, F.lit(1)).alias("grouped"), (F.col("LocusEnd") - F.col("LocusStart") + 1).alias("span")),
        ["fam"],
        {
            "n_rows": ("count", None), "n_grouped": ("count", "grouped"), "first_release": ("min", "ReleaseNr"), "last_release": ("max", "ReleaseNr"),
            "min_start": ("min", "LocusStart"), "max_end": ("max", "LocusEnd"), "sum_span": ("sum", "span"),
        },
    )


P4_FAMILY_RESULTS = """
WITH f AS (SELECT try_cast(nullif(regexp_extract(OmaHOG, '^\\s*HOG:[A-Za-z]*0*([0-9]+)', 1), '') AS BIGINT) AS fam, * FROM entry)
SELECT fam, count(*) AS n_rows, count(*) FILTER (WHERE OmaGroup > 0) AS n_grouped, min(ReleaseNr) AS first_release, max(ReleaseNr) AS last_release,
  min(LocusStart) AS min_start, max(LocusEnd) AS max_end, CAST(sum(LocusEnd - LocusStart + 1) AS BIGINT) AS sum_span
FROM f GROUP BY fam"""


def _rows(spark: SparkSession, sf: str, *, each_once: bool = True):
    """References as loaded, or each RowNr of a release once."""
    go = table(spark, sf, "go_annotation").select("RowNr", "ReleaseNr", "EntryNr", "TermNr")
    xref = table(spark, sf, "xref").select("RowNr", "ReleaseNr", "EntryNr")
    return (go.distinct(), xref.distinct()) if each_once else (go, xref)


def _releases(*tables: DataFrame) -> list[int]:
    """The release numbers of the tables: a handful, they are the periods of the reports."""
    every = tables[0].select("ReleaseNr")
    for t in tables[1:]:
        every = every.union(t.select("ReleaseNr"))
    return sorted(r[0] for r in every.where("ReleaseNr IS NOT NULL").distinct().collect())


#: The references: (table, field, space of the targets).
FIELDS = (("go_annotation", "EntryNr", "entry"), ("go_annotation", "TermNr", "term"), ("xref", "EntryNr", "entry"))


def _reference_state(spark: SparkSession, sf: str, *, each_once: bool = True):
    """References and existence per (space, release, key): sums of signed deltas. A release changes its own period only."""
    go, xref = _rows(spark, sf, each_once=each_once)
    entry = table(spark, sf, "entry")
    periods = _releases(*_rows(spark, sf, each_once=False))
    deltas = [
        *[orphans.reference_deltas({"go_annotation": go, "xref": xref}[tab], space, "ReleaseNr", field) for tab, field, space in FIELDS],
        orphans.presence_deltas(entry, "entry", "ReleaseNr", "EntryNr"),
        orphans.lifespan_deltas(table(spark, sf, "go_term"), "term", "AddedIn", "ObsoleteIn", "TermNr", periods),
    ]
    return go, xref, orphans.apply_deltas(None, *deltas)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations and cross-references whose target is missing in their own release."""
    go, xref, state = _reference_state(spark, sf, each_once=False)  # a repeated row changes no sign, and is dropped at the end
    referenced = spill(state.where("refs > 0").withColumn("orphan", F.col("present") <= 0).drop("present"), "references")
    total = referenced.agg(F.sum("refs")).first()[0] or 0
    heavy = max(1, total // HEAVY_FRACTION)
    marked = referenced.where(F.col("orphan") | (F.col("refs") >= heavy))
    parts = [
        orphans.orphan_rows({"go_annotation": go, "xref": xref}[tab], marked, space, "ReleaseNr", field, "RowNr", heavy)
        .select(F.lit(tab).alias("tab"), F.lit(field).alias("field"), F.col("rel_nr").cast("bigint").alias("rel_nr"), "row_nr")
        for tab, field, space in FIELDS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_P5_ROWS = """
r AS (
  SELECT 'go_annotation' AS tab, 'EntryNr' AS field, CAST(ReleaseNr AS BIGINT) AS rel_nr, RowNr AS row_nr, EntryNr AS k FROM go_annotation
  UNION ALL SELECT 'go_annotation', 'TermNr', ReleaseNr, RowNr, TermNr FROM go_annotation
  UNION ALL SELECT 'xref', 'EntryNr', ReleaseNr, RowNr, EntryNr FROM xref),
lost AS (
  SELECT DISTINCT r.tab, r.field, r.rel_nr, r.row_nr, r.k FROM r
  LEFT JOIN (SELECT DISTINCT ReleaseNr, EntryNr FROM entry) e ON r.field = 'EntryNr' AND e.ReleaseNr = r.rel_nr AND e.EntryNr = r.k
  LEFT JOIN (SELECT DISTINCT TermNr, AddedIn, ObsoleteIn FROM go_term) t ON r.field = 'TermNr' AND t.TermNr = r.k
    AND (t.AddedIn IS NULL OR t.AddedIn <= r.rel_nr) AND (t.ObsoleteIn IS NULL OR r.rel_nr < t.ObsoleteIn)
  WHERE r.k IS NOT NULL AND r.k <> 0 AND e.EntryNr IS NULL AND t.TermNr IS NULL)"""

P5_FOUND = f"WITH {_P5_ROWS} SELECT tab, field, rel_nr, row_nr FROM lost"


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, field and release: missing keys and rows, each RowNr once."""
    go, xref, state = _reference_state(spark, sf)
    missing = state.where("present <= 0 AND refs > 0").select("space", "period", "key")
    refs = None
    for tab, field, space in FIELDS:
        df = {"go_annotation": go, "xref": xref}[tab]
        own = df.select(F.lit(tab).alias("tab"), F.lit(field).alias("field"), F.lit(space).alias("space"), F.col("ReleaseNr").cast("int").alias("period"), F.col(field).cast("bigint").alias("key"))
        refs = own if refs is None else refs.unionByName(own)
    counted = refs.where("key <> 0").groupBy("tab", "field", "space", "period", "key").agg(F.count(F.lit(1)).alias("n"))  # one row per key before the join
    lost = counted.join(missing, ["space", "period", "key"])
    return lost.groupBy("tab", "field", F.col("period").cast("bigint").alias("rel_nr")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))


P5_REPORT = f"WITH {_P5_ROWS} SELECT tab, field, rel_nr, count(DISTINCT k) AS n_keys, count(*) AS n_rows FROM lost GROUP BY ALL"


def p5_by_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan keys of the references of the newest release, kept current over all releases by signed change deltas.

    The state starts empty. From each release to the next, references that went are counted -1 and those that came +1, and so are the
    targets; after the last step the keys with references and no existence are those a full recomputation finds.
    """
    go, xref = _rows(spark, sf)
    entry = table(spark, sf, "entry")
    now = F.lit(0).alias("now")
    refs = go.select("ReleaseNr", "EntryNr", "RowNr", now).unionByName(xref.select("ReleaseNr", "EntryNr", (-F.col("RowNr") - 1).alias("RowNr"), now)).distinct()
    held = entry.select("ReleaseNr", "EntryNr", now).distinct()
    state, before = None, None
    for release in _releases(*_rows(spark, sf, each_once=False), entry):
        deltas = []
        for df, make in ((refs, orphans.reference_deltas), (held, orphans.presence_deltas)):
            new = df.where(F.col("ReleaseNr") == release).drop("ReleaseNr")
            old = df.where(F.col("ReleaseNr") == before).drop("ReleaseNr") if before is not None else new.where("false")
            deltas += [make(new.exceptAll(old), "entry", "now", "EntryNr"), make(old.exceptAll(new), "entry", "now", "EntryNr", sign=-1)]
        updated = spill(orphans.apply_deltas(state, *deltas), "counts")
        if state is not None:
            discard(state)
        state, before = updated, release
    if state is None:
        return spark.createDataFrame([], "entry_nr bigint, n_refs bigint")
    return orphans.orphan_keys(state).select(F.col("key").alias("entry_nr"), F.col("refs").alias("n_refs"))


P5_BY_DELTAS = """
WITH m AS (SELECT max(r) AS r FROM (SELECT ReleaseNr AS r FROM go_annotation UNION ALL SELECT ReleaseNr FROM xref UNION ALL SELECT ReleaseNr FROM entry)),
a AS (SELECT DISTINCT 'g' AS t, RowNr, EntryNr FROM go_annotation, m WHERE ReleaseNr = m.r UNION ALL SELECT DISTINCT 'x', RowNr, EntryNr FROM xref, m WHERE ReleaseNr = m.r)
SELECT EntryNr AS entry_nr, count(*) AS n_refs FROM a WHERE EntryNr <> 0 AND EntryNr NOT IN (SELECT EntryNr FROM entry, m WHERE ReleaseNr = m.r) GROUP BY 1"""


def _entry_changes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "entry")
    periods = [r[0] for r in e.select("ReleaseNr").distinct().collect()]  # the few release numbers
    now = snapshots.latest_delivery(
        e.select("ReleaseNr", "EntryNr", "OmaGroup", "OmaHOG", "DeliveredAt"), ["ReleaseNr", "EntryNr"], "DeliveredAt",
        {"OmaGroup": F.coalesce(F.col("OmaGroup"), F.lit(0)), "OmaHOG": F.coalesce(F.col("OmaHOG"), F.lit(""))},
    )
    plain = now.withColumn("OmaHOG", hogid.plain_id("OmaHOG"))
    return snapshots.snapshot_changes(plain, "ReleaseNr", "EntryNr", ["OmaGroup", "OmaHOG"], periods)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Entries added, removed or changed (flat group or HOG) from each release to the next."""
    return _entry_changes(spark, sf).select(F.col("ReleaseNr").cast("bigint").alias("rel_nr"), F.col("EntryNr").alias("entry_nr"), "change_kind")


def p6_changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """How many entries changed in which combination of fields, per later release."""
    return (
        _entry_changes(spark, sf)
        .groupBy(F.col("ReleaseNr").cast("bigint").alias("rel_nr"), "change_kind", F.array_join("changed_fields", ",").alias("fields"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


_P6 = """
WITH s AS (SELECT ReleaseNr AS r, EntryNr AS e, coalesce(OmaGroup, 0) AS g,
    regexp_replace(regexp_replace(trim(coalesce(OmaHOG, '')), '_-?[0-9]+$', ''), '^(HOG:[A-Za-z]*)0+([0-9])', '\\1\\2') AS h,
    row_number() OVER (PARTITION BY ReleaseNr, EntryNr ORDER BY DeliveredAt DESC NULLS LAST, coalesce(OmaGroup, 0) DESC, coalesce(OmaHOG, '') DESC) AS rn FROM entry),
d AS (SELECT r, e, g, h FROM s WHERE rn = 1),
n AS (SELECT DISTINCT r FROM d),
p AS (SELECT r AS r2, lag(r) OVER (ORDER BY r) AS r1 FROM n),
o AS (SELECT p.r2, d.* FROM d JOIN p ON d.r = p.r1),
w AS (SELECT p.r2, d.* FROM d JOIN p ON d.r = p.r2 AND p.r1 IS NOT NULL),
c AS (SELECT CAST(coalesce(o.r2, w.r2) AS BIGINT) AS rel_nr, coalesce(o.e, w.e) AS entry_nr,
    CASE WHEN o.e IS NULL THEN 'added' WHEN w.e IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
    CASE WHEN o.e IS NULL OR w.e IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.g <> w.g THEN 'OmaGroup' END, CASE WHEN o.h <> w.h THEN 'OmaHOG' END) END AS fields
  FROM o FULL JOIN w ON o.r2 = w.r2 AND o.e = w.e
  WHERE o.e IS NULL OR w.e IS NULL OR o.g <> w.g OR o.h <> w.h)
"""
P6_FOUND = _P6 + "SELECT rel_nr, entry_nr, change_kind FROM c"
P6_CHANGED_FIELDS = _P6 + "SELECT rel_nr, change_kind, fields, count(*) AS n FROM c GROUP BY ALL"

QUERIES = {
    "p4_found": p4_found, "p4_family_results": p4_family_results,
    "p5_found": p5_found, "p5_report": p5_report, "p5_by_deltas": p5_by_deltas,
    "p6_found": p6_found, "p6_changed_fields": p6_changed_fields,
}
ORACLE = {
    "p4_found": P4_FOUND, "p4_family_results": P4_FAMILY_RESULTS, "p5_found": P5_FOUND, "p5_report": P5_REPORT, "p5_by_deltas": P5_BY_DELTAS,
    "p6_found": P6_FOUND, "p6_changed_fields": P6_CHANGED_FIELDS,
}

