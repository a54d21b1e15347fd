"""Queries on similarity, gene order, synteny graphs, homoeologs and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylolake.functions import hogid
from phylolake.operators import graphops, homoeology, matches, relations, similarity, synteny
from phylolake.plans import domain as D
from phylolake.plans.registry import Registry
from phylolake.session import table

R = Registry(D.VIEWS)
Spark = SparkSession

_ORDER = "go AS (SELECT *, row_number() OVER (PARTITION BY species_code, chromosome ORDER BY locus_start, entry_nr) AS pos FROM main_v)"


@R.query(f"WITH {_ORDER} SELECT q.entry_nr AS query_nr, g.entry_nr, CAST(g.pos - q.pos AS INT) AS \"offset\" FROM go q JOIN go g ON q.species_code = g.species_code AND q.chromosome = g.chromosome AND abs(g.pos - q.pos) <= 2 WHERE q.entry_nr % 50 = 0")
def gene_neighbourhood(s: Spark, sf: str) -> DataFrame:
    """Two genes on either side of every entry whose number is divisible by 50."""
    e = D.entry(s, sf)
    return synteny.neighbours(e, e.where("entry_nr % 50 = 0"), 2).withColumn("offset", F.col("offset").cast("int"))


_EDGES = f"{_ORDER}, ed AS (SELECT species_code, entry_nr AS node1, lead(entry_nr) OVER (PARTITION BY species_code, chromosome ORDER BY pos) AS node2 FROM go)"


@R.query(f"WITH {_EDGES} SELECT species_code, node1, node2, 1 AS weight FROM ed WHERE node2 IS NOT NULL")
def adjacent_gene_edges(s: Spark, sf: str) -> DataFrame:
    return synteny.adjacent_edges(D.entry(s, sf))


@R.query(f"""WITH {_EDGES}, b AS (SELECT node1 AS x, node2 AS y FROM ed WHERE node2 IS NOT NULL UNION SELECT node2, node1 FROM ed WHERE node2 IS NOT NULL), c AS (SELECT min(x) AS n FROM b),
  r1 AS (SELECT n, 0 AS d FROM c UNION SELECT y, 1 FROM b JOIN c ON x = n), r2 AS (SELECT * FROM r1 UNION SELECT y, d + 1 FROM b JOIN r1 ON x = n), r3 AS (SELECT * FROM r2 UNION SELECT y, d + 1 FROM b JOIN r2 ON x = n)
  SELECT n AS node, CAST(min(d) AS INT) AS dist FROM r3 GROUP BY 1 HAVING min(d) <= 3""")
def synteny_bfs(s: Spark, sf: str) -> DataFrame:
    """Genes within three steps of the first gene."""
    e = synteny.adjacent_edges(D.entry(s, sf))
    centre = e.select(F.least("node1", "node2").alias("node")).agg(F.min("node").alias("node"))
    return synteny.neighbourhood(e, centre, 3)[0]


@R.query(f"""WITH {_ORDER}, hd AS (SELECT * FROM go WHERE hog_id <> ''), ed AS (SELECT hog_id AS a, lead(hog_id) OVER (PARTITION BY species_code, chromosome ORDER BY locus_start, entry_nr) AS b FROM hd),
  p AS (SELECT string_split(a, '.')[1] AS p1, string_split(b, '.')[1] AS p2 FROM ed WHERE b IS NOT NULL) SELECT least(p1, p2) AS node1, greatest(p1, p2) AS node2, count(*) AS weight FROM p WHERE p1 <> p2 GROUP BY 1, 2""")
def family_synteny(s: Spark, sf: str) -> DataFrame:
    """Adjacency of genes lifted from their groups to the families."""
    e = D.main(s, sf).where("hog_id <> ''")
    edges = synteny.adjacent_edges(e, "hog_id")
    parents = e.select(F.col("hog_id").alias("node"), hogid.tokens("hog_id")[0].alias("parent")).distinct()
    return synteny.lift_edges(edges, parents)


@R.query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY species_code ORDER BY chromosome, locus_start, entry_nr) AS pos FROM main_v), p AS (SELECT DISTINCT entry_nr1, entry_nr2 FROM pair_v WHERE rel_type <= 3),
  nb AS (SELECT q.entry_nr AS q, g.entry_nr AS x FROM o q JOIN o g ON q.species_code = g.species_code AND q.chromosome = g.chromosome AND abs(q.pos - g.pos) <= 5), n AS (SELECT q, count(*) AS n FROM nb GROUP BY 1),
  h AS (SELECT p.entry_nr1, p.entry_nr2, count(DISTINCT a.x) AS h1, count(DISTINCT b.x) AS h2 FROM p JOIN nb a ON a.q = p.entry_nr1 JOIN p r ON r.entry_nr1 = a.x JOIN nb b ON b.q = p.entry_nr2 AND b.x = r.entry_nr2 GROUP BY 1, 2)
  SELECT entry_nr1, entry_nr2, round(((h1 - 1) / (a.n - 1) + (h2 - 1) / (b.n - 1)) / 2, 9) AS synteny FROM h JOIN n a ON a.q = entry_nr1 JOIN n b ON b.q = entry_nr2 WHERE a.n > 1 AND b.n > 1""")
def synteny_score(s: Spark, sf: str) -> DataFrame:
    return synteny.synteny_scores(D.pair(s, sf).where("rel_type <= 3"), D.entry(s, sf)).withColumn("synteny", F.round("synteny", 9))


@R.query("""WITH f AS (SELECT fam FROM entry_v WHERE fam IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, fam LIMIT 1), a AS (SELECT DISTINCT g.entry_nr AS e, g.term_nr AS t FROM go_v g JOIN entry_v e ON e.entry_nr = g.entry_nr JOIN f ON f.fam = e.fam), n AS (SELECT e, count(*) AS n FROM a GROUP BY 1)
  SELECT x.e AS entry1, y.e AS entry2, round(count(*) / (min(nx.n) + min(ny.n) - count(*))::DOUBLE, 9) AS similarity FROM a x JOIN a y ON x.t = y.t AND x.e < y.e JOIN n nx ON nx.e = x.e JOIN n ny ON ny.e = y.e GROUP BY 1, 2""")
def jaccard_gene_similarity(s: Spark, sf: str) -> DataFrame:
    """Term-set similarity among the members of the largest family."""
    e = D.entry(s, sf)
    fam = e.where("fam IS NOT NULL").groupBy("fam").count().orderBy(F.desc("count"), "fam").first()[0]
    return similarity.gene_similarity(D.go(s, sf), e.where(F.col("fam") == fam), digits=9)


def _plain_members(s: Spark, sf: str, release: int) -> DataFrame:
    e = table(s, sf, "entry").where(F.col("ReleaseNr") == release).select(hogid.plain_id("OmaHOG").alias("hog_id"), F.col("EntryNr").cast("string").alias("m")).where("hog_id LIKE 'HOG:%'")
    return similarity.member_sets(e, "m")


_PLAIN = "regexp_replace(regexp_replace(trim(coalesce(OmaHOG, '')), '_-?[0-9]+$', ''), '^(HOG:[A-Za-z]*)0+([0-9])', '\\1\\2')"
_UP = "unnest(list_transform(range(1, len(string_split(h, '.')) + 1), lambda i: array_to_string(list_slice(string_split(h, '.'), 1, i), '.')))"


@R.query(f"""WITH o AS (SELECT DISTINCT {_UP} AS h, e FROM (SELECT DISTINCT {_PLAIN} AS h, EntryNr AS e FROM entry WHERE ReleaseNr = (SELECT max(ReleaseNr) FROM entry WHERE ReleaseNr < (SELECT max(ReleaseNr) FROM entry))) WHERE h LIKE 'HOG:%'), w AS (SELECT DISTINCT {_UP} AS h, e FROM (SELECT DISTINCT {_PLAIN} AS h, EntryNr AS e FROM entry WHERE ReleaseNr = (SELECT max(ReleaseNr) FROM entry)) WHERE h LIKE 'HOG:%'),
  no AS (SELECT h, count(*) AS n FROM o GROUP BY 1), nw AS (SELECT h, count(*) AS n FROM w GROUP BY 1), j AS (SELECT o.h AS old_id, w.h AS new_id, count(*) AS k FROM o JOIN w ON o.e = w.e GROUP BY 1, 2),
  sc AS (SELECT old_id, new_id, k / (no.n + nw.n - k)::DOUBLE AS jac FROM j JOIN no ON no.h = old_id JOIN nw ON nw.h = new_id), r AS (SELECT *, max(jac) OVER (PARTITION BY old_id) AS best, row_number() OVER (PARTITION BY old_id ORDER BY jac DESC, new_id) AS rn FROM sc),
  kept AS (SELECT * FROM r WHERE best > 0.6 AND (best < 1 OR jac = 1))
  SELECT old_id, new_id, round(jac, 9) AS jaccard, (count(*) OVER (PARTITION BY old_id) > 10 AND coalesce(max(CASE WHEN rn = 7 THEN jac END) OVER (PARTITION BY old_id), 0) > 0.9)::INT AS dubious FROM kept""")
def hog_map(s: Spark, sf: str) -> DataFrame:
    """Groups of the release before the newest mapped to those of the newest by their members."""
    old, new = ([None, None] + D.releases(s, sf))[-2:]
    out = similarity.forward_map(_plain_members(s, sf, old), _plain_members(s, sf, new))
    return out.select("old_id", "new_id", F.round("jaccard", 9).alias("jaccard"), F.col("dubious").cast("int").alias("dubious"))


def _profiles(s: Spark, sf: str) -> DataFrame:
    return table(s, sf, "hog_profile").select("ProfileId", F.explode("species_profile").alias("x")).where("x IS NOT NULL AND x <> -1").distinct()


@R.query("""WITH p AS (SELECT DISTINCT ProfileId AS p, x FROM (SELECT ProfileId, unnest(species_profile) AS x FROM hog_profile) WHERE x IS NOT NULL AND x <> -1), n AS (SELECT p, count(*) AS n FROM p GROUP BY 1),
  j AS (SELECT a.p AS q, b.p AS r, count(*) AS k FROM p a JOIN p b ON a.x = b.x AND a.p <> b.p WHERE a.p % 50 = 0 GROUP BY 1, 2), sc AS (SELECT q, r, k / (x.n + y.n - k)::DOUBLE AS jac FROM j JOIN n x ON x.p = q JOIN n y ON y.p = r)
  SELECT q AS query, r AS "ProfileId", round(jac, 9) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY jac DESC, r) AS rn FROM sc) WHERE rn <= 10""")
def similar_profiles(s: Spark, sf: str) -> DataFrame:
    """The ten profiles most similar to every fiftieth one."""
    p = _profiles(s, sf)
    return similarity.profile_neighbours(p, "ProfileId", "x", p.where("ProfileId % 50 = 0"), k=10).withColumn("jaccard", F.round("jaccard", 9))


@R.query()
def profile_signatures(s: Spark, sf: str) -> DataFrame:
    return similarity.minhash_signature(_profiles(s, sf), "ProfileId", "x", n=64)


@R.query()
def mds_layout(s: Spark, sf: str) -> DataFrame:
    """Layout of the annotated members of every family by the similarity of their terms."""
    e = D.entry(s, sf).where("fam IS NOT NULL").select("entry_nr", "fam")
    a = D.go(s, sf).select("entry_nr", "term_nr").distinct().join(e, "entry_nr")
    return similarity.term_layout(a, group="fam", node="entry_nr", item="term_nr", dimensions=1)


@R.query()
def graph_fork_removal(s: Spark, sf: str) -> DataFrame:
    return graphops.clean_graph(family_synteny(s, sf))


@R.query(f"WITH {_EDGES} SELECT count(*) AS n_edges FROM ed WHERE node2 IS NOT NULL")
def synteny_edge_count(s: Spark, sf: str) -> DataFrame:
    return synteny.adjacent_edges(D.entry(s, sf)).agg(F.count(F.lit(1)).alias("n_edges"))


def _fuzzy_sql() -> str:
    shape = {
        "d": {"low": ("0.0", "mx / 10"), "med": ("mx / 4", "mx / 10"), "high": ("mx", "mx / 2.5")},
        "s": {"low": ("0.0", "0.15"), "med": ("0.3", "0.15"), "high": ("1.0", "0.4")},
        "c": {"low": ("md", "md"), "med": ("4 * md", "1.5 * md"), "high": ("mc", "mc / 2.5")},
    }
    member = {v: {k: f"exp(-pow({v} - ({c}), 2) / (2 * pow({w}, 2)))" for k, (c, w) in lv.items()} for v, lv in shape.items()}
    parts = {k: [] for k in homoeology.CONFIDENCE}
    for (sy, di), outcome in homoeology.RULES.items():
        for co, level in zip(homoeology.LEVELS, outcome, strict=True):
            parts[level].append(f"least({member['s'][sy]}, {member['d'][di]}, {member['c'][co]})")
    rules = ", ".join(f"greatest({', '.join(v)}) AS r_{k}" for k, v in parts.items())
    height = "greatest(" + ", ".join(f"least(r_{k}, exp(-pow(x - {c}, 2) / {2 * w * w}))" for k, (c, w) in homoeology.CONFIDENCE.items()) + ")"
    return f"""i AS (SELECT EntryNr1 AS entry_nr1, EntryNr2 AS entry_nr2, min(CASE WHEN Distance >= 0 THEN round(Distance::DOUBLE, 1) ELSE 100.0 END) AS d, max(CASE WHEN SyntenyConservationLocal >= 0 THEN round(SyntenyConservationLocal::DOUBLE, 1) ELSE 0.0 END) AS s
      FROM pairwise WHERE RelType = 5 AND EntryNr1 <> 0 AND EntryNr2 <> 0 AND EntryNr1 <> EntryNr2 GROUP BY 1, 2),
    c AS (SELECT *, count(*) OVER (PARTITION BY entry_nr1) + count(*) OVER (PARTITION BY entry_nr2) AS c FROM i), st AS (SELECT max(d) AS mx, median(c)::DOUBLE AS md, max(c)::DOUBLE AS mc FROM c),
    rr AS (SELECT d, s, c, {rules} FROM (SELECT DISTINCT d, s, c FROM c), st),
    f AS (SELECT d, s, c, sum(x * {height}) / sum({height}) AS f FROM rr, (SELECT unnest(range(0, 101))::DOUBLE AS x) GROUP BY 1, 2, 3)"""


@R.query(f"WITH {_fuzzy_sql()} SELECT entry_nr1, entry_nr2, round((SELECT min(f) FROM f) + (f.f - (SELECT min(f) FROM f)) * (100 - (SELECT min(f) FROM f)) / ((SELECT max(f) FROM f) - (SELECT min(f) FROM f)), 4) AS confidence FROM c JOIN f ON f.d = c.d AND f.s = c.s AND f.c = c.c")
def homoeolog_confidence(s: Spark, sf: str) -> DataFrame:
    p = table(s, sf, "pairwise").where("RelType = 5 AND EntryNr1 <> 0 AND EntryNr2 <> 0 AND EntryNr1 <> EntryNr2")
    one = p.groupBy(F.col("EntryNr1").alias("entry_nr1"), F.col("EntryNr2").alias("entry_nr2")).agg(
        F.min(F.when(F.col("Distance") >= 0, F.round(F.col("Distance").cast("double"), 1)).otherwise(100.0)).alias("distance"),
        F.max(F.when(F.col("SyntenyConservationLocal") >= 0, F.round(F.col("SyntenyConservationLocal").cast("double"), 1)).otherwise(0.0)).alias("synteny"),
    )
    return homoeology.homoeolog_confidence(relations.copy_number(one)).select("entry_nr1", "entry_nr2", F.round("confidence", 4).alias("confidence"))


@R.query("""SELECT p.entry_nr1, p.entry_nr2, coalesce(a.ids, '') AS ids1, coalesce(b.ids, '') AS ids2 FROM pair_v p LEFT JOIN (SELECT entry_nr, string_agg(DISTINCT xref_id, '; ' ORDER BY xref_id) AS ids FROM xref_v WHERE source = 95 GROUP BY 1) a ON a.entry_nr = p.entry_nr1
  LEFT JOIN (SELECT entry_nr, string_agg(DISTINCT xref_id, '; ' ORDER BY xref_id) AS ids FROM xref_v WHERE source = 95 GROUP BY 1) b ON b.entry_nr = p.entry_nr2 WHERE p.rel_type = 5""")
def homoeologs_with_source_ids(s: Spark, sf: str) -> DataFrame:
    out = homoeology.with_source_ids(D.pair(s, sf).where("rel_type = 5"), D.xref(s, sf).where("source = 95"))
    return out.select("entry_nr1", "entry_nr2", F.coalesce("source_ids1", F.lit("")).alias("ids1"), F.coalesce("source_ids2", F.lit("")).alias("ids2"))


def _matches(s: Spark, sf: str) -> DataFrame:
    return table(s, sf, "lineitem").groupBy(F.col("l_orderkey").alias("entry_nr1"), F.col("l_partkey").alias("entry_nr2")).agg(
        F.max(F.col("l_returnflag") == "N").alias("is_stable"), F.max((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("is_verified"), F.max(F.col("l_linenumber") <= 3).alias("is_canonical")
    )


@R.query("""WITH m AS (SELECT l_orderkey AS a, l_partkey AS b, bool_or(l_returnflag = 'N') AS sp, bool_or(l_returnflag = 'N' AND l_linestatus = 'O') AS vp, bool_or(l_linenumber <= 3) AS ca FROM lineitem GROUP BY 1, 2)
  SELECT 'SP' AS kind, count(*) AS n FROM m WHERE sp AND ca UNION ALL SELECT 'VP', count(*) FROM m WHERE vp AND ca UNION ALL SELECT 'ALL', count(*) FROM m""")
def match_views(s: Spark, sf: str) -> DataFrame:
    m = _matches(s, sf)
    parts = [matches.view(m, k, canonical_only=k != "ALL").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("SP", "VP", "ALL")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.query("""WITH m AS (SELECT l_orderkey AS entry_nr1, l_partkey AS entry_nr2, bool_or(l_linenumber <= 3) AS ca FROM lineitem GROUP BY 1, 2) SELECT entry_nr1, entry_nr2, ca::INT AS is_verified FROM m""")
def match_flag_update(s: Spark, sf: str) -> DataFrame:
    m = _matches(s, sf)
    return matches.set_flag(m, m.where("is_canonical"), "is_verified").select("entry_nr1", "entry_nr2", F.col("is_verified").cast("int").alias("is_verified"))


QUERIES, ORACLE = R.queries, R.sql
