"""Frequency of every distinct term by a range-partitioned external sort and run-length scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylolake.session import ship_package


def _combine(batches):
    """Runs of equal pairs inside a batch become one row, so a hot pair is thinned before the sort."""
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch]).group_by(["term", "record"]).aggregate([("n", "sum")])
            yield from t.rename_columns(["term", "record", "n"]).combine_chunks().to_batches()


def _scan(batches):
    """Run-length scan of sorted (term, record, n): partial (term, occurrences, records) of every run of a term.

    Equal pairs lie in one partition, so the distinct records of a term simply add
    up over batches and partitions; only the last pair is carried between batches.
    """
    last = None
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        term, record, n = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        other = np.ones(rows, bool)
        fresh = np.ones(rows, bool)
        if rows > 1:
            other[1:] = pc.not_equal(term.slice(1), term.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            fresh[1:] = other[1:] | pc.not_equal(record.slice(1), record.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        if last is not None and last == (term[0].as_py(), record[0].as_py()):
            fresh[0] = False
        starts = np.flatnonzero(other)
        yield pa.RecordBatch.from_arrays(
            [term.take(pa.array(starts)), pa.array(np.add.reduceat(n, starts)), pa.array(np.add.reduceat(fresh.astype(np.int64), starts))],
            names=["term", "occurrences", "records"],
        )
        last = (term[rows - 1].as_py(), record[rows - 1].as_py())


def term_frequency(df: DataFrame, term: str, record: str, absent: tuple = ()) -> DataFrame:
    """(term, occurrences, records) of every distinct term.

    Rows whose term or record is null or in ``absent`` are left out; repeated rows
    count as occurrences but as one record. An empty table gives an empty result.
    The sort is by (term, record), so a term with a third of all rows spreads over
    many partitions.
    """
    t, r = F.col(term), F.col(record)
    keep = t.isNotNull() & r.isNotNull()
    if absent:
        keep = keep & ~t.isin(*absent) & ~r.isin(*absent)
    pairs = df.where(keep).select(t.alias("term"), r.alias("record"), F.lit(1).cast("bigint").alias("n"))
    kind = dict(pairs.dtypes)
    ship_package(df.sparkSession)
    combined = pairs.mapInArrow(_combine, f"term {kind['term']}, record {kind['record']}, n bigint")
    ordered = combined.repartitionByRange("term", "record").sortWithinPartitions("term", "record")
    runs = ordered.mapInArrow(_scan, f"term {kind['term']}, occurrences bigint, records bigint")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_frequency(df: DataFrame, term: str, record: str, absent: tuple = (), rare_records: int = 2, common_percent: float = 5) -> DataFrame:
    """Frequencies with a mark: 'rare' for at most ``rare_records`` records, 'common' for more than
    ``common_percent`` percent of all distinct records, else null.

    A term that is both (few records in all) counts as rare.
    """
    freq = term_frequency(df, term, record, absent)
    r = F.col(record)
    keep = F.col(term).isNotNull() & r.isNotNull()
    if absent:
        keep = keep & ~F.col(term).isin(*absent) & ~r.isin(*absent)
    total = df.where(keep).select(r).distinct().count()  # one number
    mark = F.when(F.col("records") <= rare_records, F.lit("rare")).when(F.col("records") * 100 > F.lit(total * common_percent), F.lit("common"))
    return freq.select("term", "occurrences", "records", mark.alias("mark"))
