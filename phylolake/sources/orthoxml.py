"""Nested group files (OrthoXML): level rows with labelled ids, top-level groups, splitting.

Group files are read tag by tag in byte ranges and cut into their top-level groups; each is labelled in a Python
worker, as XML of unbounded depth is out of reach of native expressions.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phylolake.errors import BoundExceeded
from phylolake.session import ship_package

GROUP = "orthologGroup"
REFERENCE = r"""geneRef[^<>]*\bid\s*=\s*["']([^"']*)["']"""
LEVEL_SCHEMA = "fam bigint, hog_id string, level string, completeness double, implied_losses int, nr_members int, is_root boolean"


def check_letters(letters: str) -> str:
    """Release letters of new ids: none or one capital letter."""
    if not re.fullmatch(r"[A-Z]?", letters):
        raise ValueError(f"release letters have to be one capital letter, not {letters!r}")
    return letters


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _letters(n: int) -> str:
    """a, b, ... z, aa, ab, ..."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def label_members(group, fam_id: str) -> tuple[dict[int, str], dict[str, str]]:
    """Ids by element of the (sub-)groups and by gene, after the LOFT scheme.

    Below a duplication every copy gets the running number of the duplications of
    the family and a letter of its own; all else inherits the id of its group.
    """
    counter, group_id, gene_id = [0], {}, {}

    def walk(e, current):
        kind = _tag(e)
        if kind == GROUP:
            group_id[id(e)] = current
            for c in e:
                walk(c, current)
        elif kind == "paralogGroup":
            counter[0] += 1
            nr = counter[0]
            copies = [c for c in e if _tag(c) in (GROUP, "paralogGroup", "geneRef")]
            for k, c in enumerate(copies):
                walk(c, f"{current}.{nr}{_letters(k)}")
        elif kind == "geneRef":
            gene_id[e.get("id")] = current

    walk(group, fam_id)
    return group_id, gene_id


def _scores(e, inherited):
    got = dict(inherited)
    for c in e:
        if _tag(c) == "score":
            got[c.get("id")] = float(c.get("value"))
    return got


def _ranges(e):
    return [c for c in e if _tag(c) == "property" and c.get("name") == "TaxRange"]


def implied_clades(xml: str, species: dict[str, str]) -> set[tuple[str, str]]:
    """(level, species) pairs that the nesting of one group shows."""
    out = set()
    for e in ET.fromstring(xml).iter():
        if _tag(e) == GROUP:
            below = {species[g.get("id")] for g in e.iter() if _tag(g) == "geneRef" and g.get("id") in species}
            out |= {(r.get("value"), s) for r in _ranges(e) for s in below}
    return out


def level_rows(xml: str, fam: int, species: dict[str, str], clades: dict[str, frozenset[str]], letters: str = "") -> list[tuple]:
    """Level rows of one top-level group given as XML text, from the outermost level to the species.

    Levels that the file skips are filled in: between a group and its parts lie
    all clades that contain the part and are contained in the group's own level. Scores
    given for a group, or for one of its levels, hold; else the completeness is the
    share of the clade's species with a member and the losses are -1.
    """
    root = ET.fromstring(xml)
    fam_id = f"HOG:{letters}{fam:07d}"
    group_id, gene_id = label_members(root, fam_id)
    rows: dict[tuple[str, str], dict] = {}

    def add(hog, level, genes, scores=None, count=None):
        r = rows.setdefault((hog, level), {"genes": set(), "scores": {}, "count": None})
        r["genes"] |= genes
        r["scores"].update(scores or {})
        r["count"] = count if count is not None else r["count"]

    def between(outer, inner):
        """Clades inside ``outer`` around the species in ``inner``, widest first."""
        limit = clades.get(outer)
        hit = [c for c, s in clades.items() if inner <= s and (limit is None or s < limit)]
        return sorted(hit, key=lambda c: (-len(clades[c]), c))

    def genes_of(e):
        return {g.get("id") for g in e.iter() if _tag(g) == "geneRef"}

    def walk(e, outer):
        kind = _tag(e)
        if kind == GROUP:
            hog, genes = group_id[id(e)], genes_of(e)
            levels = _ranges(e)
            names = [lv.get("value") for lv in levels]
            covered = frozenset(species.get(g, "") for g in genes)
            own = clades.get(names[0], covered) if names else covered
            for c in between(outer, own) if outer is not None else []:
                if c not in names:
                    add(hog, c, genes)
            count = next((int(c.get("value")) for c in e if _tag(c) == "property" and c.get("name") == "NrMemberGenes"), None)
            base = _scores(e, {})
            for lv in levels:
                add(hog, lv.get("value"), genes, _scores(lv, base), count)
            for c in e:
                walk(c, names[-1] if names else outer)
        elif kind == "paralogGroup":
            for c in e:
                walk(c, outer)
        elif kind == "geneRef":
            gene, hog = e.get("id"), gene_id[e.get("id")]
            own = species.get(gene)
            if own is not None:
                for c in between(outer, frozenset([own])):
                    if c != own:
                        add(hog, c, {gene})
                add(hog, own, {gene})

    walk(root, None)
    out, seen = [], set()
    for (hog, level), r in rows.items():
        size = clades.get(level, frozenset([level]))
        covered = {species.get(g) for g in r["genes"]}
        completeness = r["scores"].get("CompletenessScore", len(covered & size) / max(1, len(size)))
        out.append((fam, hog, level, float(completeness), int(r["scores"].get("ImpliedLosses", -1)), r["count"] if r["count"] is not None else len(r["genes"]), hog not in seen))
        seen.add(hog)
    return out


GROUP_TEXT = re.compile(r"<(?:\w+:)?orthologGroup\b|</(?:\w+:)?orthologGroup\s*>|<(?:\w+:)?orthologGroup\b[^<>]*/>")


def top_level_groups(text: str) -> list[str]:
    """Texts of the outermost groups, in file order, without parsing the rest of the file."""
    start = re.search(r"<(?:\w+:)?groups\b[^<>]*>", text)
    out, depth, begin = [], 0, 0
    for m in GROUP_TEXT.finditer(text, start.end() if start else 0):
        if m.group(0).startswith("</"):
            depth -= 1
            if depth == 0:
                out.append(text[begin : m.end()])
        else:
            if depth == 0:
                begin = m.start()
            depth += 1
    return out


def _tags(spark: SparkSession, path) -> DataFrame:
    """(file, block, at, value, shut, tag, attributes): one row per tag, in the order (block, at) within its file.

    Files are cut at every '>' and read by byte ranges, so a file of any size is many tasks and never a single row; ``block`` is the
    start of the byte range, ``at`` grows within it. A '>' inside an attribute or a comment has to be written as an entity.
    """
    raw = spark.read.option("lineSep", ">").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    form = r"<(/?)(?:\w+:)?(\w+)([^<]*)$"
    part = lambda i: F.regexp_extract("value", form, i)
    return rows.select("file", "block", "at", "value", (part(1) == "/").alias("shut"), part(2).alias("tag"), part(3).alias("attributes"))


def _running(rows: DataFrame, name: str, value) -> DataFrame:
    """``rows`` with the running sum of ``value`` within each file, this row included: inside the blocks, then over the few blocks of a file."""
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum(value).alias("__n")).select("file", "block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return rows.join(blocks, ["file", "block"]).withColumn(name, F.col("__off") + F.sum(value).over(inside)).drop("__off")


def _attribute(rest: str, name: str) -> Column:
    """Value of an attribute in either kind of quotes, entities resolved; null without it."""
    found = F.regexp_extract(rest, rf"""\b{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    text = F.substring(found, F.lit(2), F.length(found) - 2)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.when(found != "", text)


def read_groups(spark: SparkSession, path) -> DataFrame:
    """(file, fam, xml): the top-level groups of the files, numbered from 1 in each file (or by a numeric id attribute).

    The depth of every tag is a running sum over its file, so the groups are found without reading a file in one piece.
    """
    group = F.col("tag").isin(GROUP, "paralogGroup") & ~F.col("attributes").endswith("/")
    step = F.when(group & F.col("shut"), -1).when(group, 1).otherwise(0)
    deep = _running(_tags(spark, path).withColumn("step", step), "depth", F.col("step"))
    deep = deep.withColumn("opens", F.when((F.col("step") == 1) & (F.col("depth") == 1), 1).otherwise(0))
    within = _running(deep, "nr", F.col("opens")).where("depth > 0 OR step = -1")
    piece = F.when(F.col("opens") == 1, F.regexp_extract("value", r"(<[^<]*)$", 1)).otherwise(F.col("value"))
    own = F.when(F.col("opens") == 1, F.regexp_extract("attributes", r"""\bid\s*=\s*["'][^"'0-9]*([0-9]+)["']""", 1).try_cast("bigint"))
    parts = within.groupBy("file", "nr").agg(F.sort_array(F.collect_list(F.struct("block", "at", piece.alias("piece")))).alias("p"), F.max(own).alias("own"))
    xml = F.concat(F.array_join(F.transform("p", lambda x: x["piece"]), ">"), F.lit(">"))
    return parts.select("file", F.coalesce("own", "nr").cast("bigint").alias("fam"), xml.alias("xml"))


def read_genes(spark: SparkSession, path) -> DataFrame:
    """(gene_ref, taxid, species, gene_id, prot_id) of the gene lists of the files; a gene belongs to the species opened before it."""
    tags = _tags(spark, path).where("NOT shut AND tag IN ('species', 'gene')")
    opened = F.when(F.col("tag") == "species", F.struct(_attribute("attributes", "NCBITaxId").try_cast("int").alias("taxid"), _attribute("attributes", "name").alias("species")))
    rows = tags.withColumn("own", opened)
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy("file", "block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("at"))).alias("o")).select("file", "block", F.last("o", ignorenulls=True).over(before).alias("carried"))
    of = F.coalesce(F.last("own", ignorenulls=True).over(inside), F.col("carried"))
    genes = rows.join(last, ["file", "block"]).withColumn("of", of).where("tag = 'gene'")
    named = {"gene_ref": "id", "gene_id": "geneId", "prot_id": "protId"}
    values = {k: _attribute("attributes", v) for k, v in named.items()}
    return genes.select(values["gene_ref"].alias("gene_ref"), F.coalesce("of.taxid", F.lit(-1)).alias("taxid"), F.col("of.species").alias("species"), values["gene_id"].alias("gene_id"), values["prot_id"].alias("prot_id"))


def _with_species(groups: DataFrame, genes: DataFrame) -> DataFrame:
    """(fam, xml, refs, names): each group with the species of its own genes."""
    ref = F.explode(F.array_distinct(F.regexp_extract_all("xml", F.lit(REFERENCE), F.lit(1))))
    used = groups.select("fam", ref.alias("gene_ref")).join(genes.select("gene_ref", "species"), "gene_ref")
    per = used.groupBy("fam").agg(F.collect_list("gene_ref").alias("refs"), F.collect_list("species").alias("names"))
    return groups.select("fam", "xml").join(per, "fam")


def clade_species(groups: DataFrame, genes: DataFrame) -> DataFrame:
    """(level, species) of all clades the groups show; replace it by the taxonomy's closure where there is one."""
    ship_package(groups.sparkSession)

    def run(batches):
        for b in batches:
            pairs = set()
            for xml, refs, names in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                pairs |= implied_clades(xml, dict(zip(refs, names, strict=True)))
            rows = sorted(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["level", "species"])

    return _with_species(groups, genes).mapInArrow(run, "level string, species string").distinct()


def hog_levels(groups: DataFrame, genes: DataFrame, letters: str = "", *, clades: DataFrame | None = None, max_clade_rows: int = 5_000_000) -> DataFrame:
    """Level rows of all groups of :func:`read_groups`.

    ``clades`` (level, species) is a taxonomy dimension; it is counted against
    ``max_clade_rows`` and sent to every task.
    """
    check_letters(letters)
    spark = groups.sparkSession
    known = (clades if clades is not None else clade_species(groups, genes)).select("level", "species").limit(max_clade_rows + 1).collect()
    if len(known) > max_clade_rows:
        raise BoundExceeded(f"more than {max_clade_rows} pairs of clade and species")
    by: dict[str, set[str]] = {}
    for level, name in known:
        by.setdefault(level, set()).add(name)
    held = spark.sparkContext.broadcast({k: frozenset(v) for k, v in by.items()})
    ship_package(spark)
    types = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
    names_ = ["fam", "hog_id", "level", "completeness", "implied_losses", "nr_members", "is_root"]

    def run(batches):
        for b in batches:
            each = zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)
            rows = [r for fam, xml, refs, names in each for r in level_rows(xml, fam, dict(zip(refs, names, strict=True)), held.value, letters)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names_)

    return _with_species(groups, genes).mapInArrow(run, LEVEL_SCHEMA)


def gene_labels(groups: DataFrame, letters: str = "") -> DataFrame:
    """(fam, gene_ref, hog_id): the labelled id of every member gene."""
    check_letters(letters)
    ship_package(groups.sparkSession)

    def run(batches):
        for b in batches:
            fam_, ref, ids = [], [], []
            for fam, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for g, h in label_members(ET.fromstring(xml), f"HOG:{letters}{fam:07d}")[1].items():
                    fam_.append(fam), ref.append(g), ids.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(fam_, pa.int64()), pa.array(ref, pa.string()), pa.array(ids, pa.string())], names=["fam", "gene_ref", "hog_id"])

    return groups.select("fam", "xml").mapInArrow(run, "fam bigint, gene_ref string, hog_id string")


def top_level_members(groups: DataFrame, *, skip_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(fam, level, members): outermost level and member genes, those with listed id prefixes left out."""
    refs = F.regexp_extract_all("xml", F.lit(REFERENCE), F.lit(1))
    if skip_prefixes:
        n = len(skip_prefixes[0])
        refs = F.filter(refs, lambda g: ~F.substring(g, 1, n).isin(*skip_prefixes))
    level = F.regexp_extract("xml", r'TaxRange"[^<>]*value="([^"]*)"', 1)
    return groups.select("fam", level.alias("level"), F.array_sort(F.array_distinct(refs)).alias("members"))


def split_families(groups: DataFrame, genes: DataFrame, families: list[int] | None = None) -> DataFrame:
    """(fam, xml): one complete document per family, with the gene lists of its species only."""
    g = groups if families is None else groups.where(F.col("fam").isin(families))
    used = g.select("fam", "xml", F.explode(F.array_distinct(F.regexp_extract_all("xml", F.lit(REFERENCE), F.lit(1)))).alias("gene_ref"))
    gene = F.concat(F.lit('<gene id="'), F.col("gene_ref"), F.lit('"'), F.coalesce(F.concat(F.lit(' protId="'), F.col("prot_id"), F.lit('"')), F.lit("")), F.lit("/>"))
    per_species = used.join(genes, "gene_ref").groupBy("fam", "taxid", "species").agg(F.array_join(F.array_sort(F.collect_list(gene)), "").alias("g"))
    sp = F.concat(F.lit('<species name="'), F.col("species"), F.lit('" NCBITaxId="'), F.col("taxid"), F.lit('"><database name="release"><genes>'), F.col("g"), F.lit("</genes></database></species>"))
    lists = per_species.groupBy("fam").agg(F.array_join(F.array_sort(F.collect_list(sp)), "").alias("species_xml"))
    head = F.lit('<?xml version="1.0" encoding="utf-8"?><orthoXML xmlns="http://orthoXML.org/2011/" version="0.3" origin="release" originVersion="1">')
    return g.join(lists, "fam").select("fam", F.concat(head, F.col("species_xml"), F.lit("<groups>"), F.col("xml"), F.lit("</groups></orthoXML>")).alias("xml"))
