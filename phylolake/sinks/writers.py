"""Writers of tables and exchange files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, *, mode: str = "append", partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Create a table, append to it, or replace its rows (``overwrite``); rows may be sorted inside files for pruning."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, *, mode: str = "overwrite") -> None:
    """A catalogue table bucketed and sorted by its join key, so later joins on it need no exchange."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def replace_column(df: DataFrame, values: DataFrame, keys: list[str], column: str, default) -> DataFrame:
    """``df`` with ``column`` taken from ``values`` (one row per key) where there is one, else ``default``.

    Keys that occur twice in ``values`` raise when the plan is built.
    """
    twice = values.groupBy(*keys).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"the new values of {column!r} are not unique per {keys}")
    new = values.select(*keys, F.col(column).alias("__new"))
    return df.drop(column).join(new, keys, "left").withColumn(column, F.coalesce("__new", F.lit(default))).drop("__new")


def _cells(df: DataFrame, sep: str) -> Column:
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])


def write_archives(lines: DataFrame, path: str, *, name: str, line: str, mode: str = "overwrite") -> None:
    """Tar archives, compressed, with one file for every value of ``name`` (up to 100 ASCII characters), holding its lines.

    A member is a row of text: its header, its lines and zeros up to a whole block of 512 bytes, of which the
    separator of the rows is the last one. An archive may lack the empty blocks at its end, which readers do without.
    """
    files = lines.groupBy(F.col(name).alias("n")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("c")).withColumn("c", F.concat("c", F.lit("\n")))
    body = F.when(F.octet_length("c") % 512 == 0, F.concat("c", F.lit("\n"))).otherwise(F.col("c"))
    zeros = lambda n: F.repeat(F.lit("\0"), n if isinstance(n, Column) else F.lit(n))
    size = F.lpad(F.conv(F.octet_length("c").cast("string"), 10, 8), 11, "0")
    fixed = "0000644\0" + "0000000\0" * 2 + "\0" + "00000000000\0" + " " * 8 + "0" + "ustar\0" + "00"
    total = F.aggregate(F.split(F.concat("n", size), ""), F.lit(sum(map(ord, fixed))), lambda a, x: a + F.ascii(x))
    check = F.concat(F.lpad(F.conv(total.cast("string"), 10, 8), 6, "0"), F.lit("\0 "))
    head = F.concat(F.col("n"), zeros(100 - F.length("n")), F.lit("0000644\0" + "0000000\0" * 2), size, F.lit("\0" + "00000000000\0"), check, F.lit("0"), zeros(100), F.lit("ustar\0" + "00"), zeros(247))
    out = files.withColumn("c", body).select(F.concat(head, F.col("c"), zeros(511 - F.octet_length("c") % 512)).alias("value"))
    out.write.mode(mode).option("lineSep", "\0").option("compression", "gzip").text(path)


def write_tsv(df: DataFrame, path: str, *, header: bool = True, compression: str | None = None, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Tab-separated files, optionally one folder per value of the partition columns."""
    writer = df.write.mode(mode).option("sep", "\t").option("header", header).option("quote", "\u0000")
    writer = writer.option("compression", compression) if compression else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_gaf(gaf: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """GAF 2.1 lines; the version line is the first of every file."""
    body = gaf.select(_cells(gaf, "\t").alias("value"))

    def with_version(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(["!gaf-version: 2.1"], b.schema.field(0).type)], schema=b.schema)
                first = False
            yield b

    body.mapInArrow(with_version, "value string").write.mode(mode).text(path)


def write_xml_per_family(docs: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One folder per family with its document."""
    docs.select("fam", "xml").write.mode(mode).partitionBy("fam").text(path)


def linkout_records(links: DataFrame, *, provider: str, base_url: str, database: str, rule: str = "&lo.id;") -> DataFrame:
    """(object_id, xml): one LinkOut element per object (column object_id, query, url_part)."""
    esc = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(
        F.lit("<Link><LinkId>"), esc(F.col("object_id")), F.lit(f"</LinkId><ProviderId>{provider}</ProviderId><ObjectSelector><Database>{database}</Database><ObjectList><Query>"),
        esc(F.col("query")), F.lit(f"</Query></ObjectList></ObjectSelector><ObjectUrl><Base>{base_url}</Base><Rule>"), F.coalesce(esc(F.col("url_part")), F.lit(rule)), F.lit("</Rule></ObjectUrl></Link>"),
    )
    return links.select("object_id", xml.alias("xml"))


def prioritised(links: DataFrame, genomes: DataFrame, *, prefixes: tuple[str, ...], limit: int) -> DataFrame:
    """The ``limit`` most useful links: genomes with a preferred code first, then large genomes, then by id."""
    first = F.when(F.col("species_code").rlike("^(" + "|".join(prefixes) + ")"), 0).otherwise(1) if prefixes else F.lit(1)
    j = links.join(genomes.select("species_code", "tot_entries"), "species_code")
    return j.orderBy(first, F.desc("tot_entries"), "object_id").limit(limit)


def write_linkout(records: DataFrame, path: str, *, per_file: int = 50_000, mode: str = "overwrite") -> None:
    """Documents of at most ``per_file`` links each."""
    records.select("xml").write.mode(mode).option("maxRecordsPerFile", per_file).text(path)


def fingerprint_links(xrefs: DataFrame, entries: DataFrame, groups: DataFrame, *, source: int) -> DataFrame:
    """(xref_id, fingerprint) of identifiers whose entry is in a flat group with a fingerprint."""
    j = xrefs.where(F.col("source") == source).join(entries.where("group_nr <> 0").select("entry_nr", "group_nr"), "entry_nr")
    return j.join(groups.where("fingerprint <> 'n/a'").select("group_nr", "fingerprint"), "group_nr").select("xref_id", "fingerprint").distinct()


def tree_events(edges: DataFrame, events: DataFrame) -> DataFrame:
    """(taxid, json): event counts of the edge above every node. ``events`` is (taxid, event, n)."""
    per = events.groupBy("taxid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event", "n")))).alias("events"))
    return edges.join(per, "taxid", "left").select("taxid", F.to_json(F.struct("taxid", "parent_taxid", F.coalesce("events", F.create_map().cast("map<string,bigint>")).alias("events"))).alias("json"))


def family_json(entries: DataFrame, *, chunk_members: int | None = None) -> DataFrame:
    """(fam, json): all members of each family as a JSON array.

    With ``chunk_members`` (fam, chunk, json): arrays of at most so many members each, numbered from 0 in the order of the entries.
    """
    members = entries.where("fam IS NOT NULL")
    member = F.struct("entry_nr", "hog_id", "species_code", "chromosome", "locus_start")
    keys = ["fam"]
    if chunk_members:
        place = F.row_number().over(Window.partitionBy("fam").orderBy(member))
        members, keys = members.withColumn("chunk", F.floor((place - 1) / chunk_members).cast("int")), ["fam", "chunk"]
    return members.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(member))).alias("json"))


def append_rows(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append to an existing table after checking that the columns fit."""
    have = spark.read.parquet(path).columns
    if sorted(have) != sorted(rows.columns):
        raise ValueError(f"the table has {have}, the rows {rows.columns}")
    rows.select(*have).write.mode("append").parquet(path)


def unfinished(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys that a resumed job still has to do."""
    return keys.select(key).distinct().join(done.select(key), key, "left_anti")
