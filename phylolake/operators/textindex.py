"""Stored indexes of text: letter n-grams of every text in a table that is pruned before it is read.

The index is a table (bucket, gram, id), partitioned by a hash bucket of the gram and sorted by gram inside the files. A search reads
the buckets of its own grams only, and within them the row groups that may hold them; what is found is verified on the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phylolake.session import spread_work


def _bucket(gram, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - (n - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class TextIndex:
    """A stored index: its table, the length of its grams, its number of buckets, and whether case counts."""

    path: str
    n: int = 3
    buckets: int = 64
    ignore_case: bool = True

    def _text(self, col) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return F.lower(c) if self.ignore_case else c

    def build(self, texts: DataFrame, id_col: str, text: str, *, mode: str = "overwrite") -> TextIndex:
        """Write the index of all texts (``append`` adds those of new texts). Null texts and texts shorter than a gram have no rows."""
        rows = spread_work(texts.select(F.col(id_col).alias("id"), F.col(text).alias("t"))).where("id IS NOT NULL AND t IS NOT NULL").select("id", F.explode(_grams(self._text("t"), self.n)).alias("gram"))
        placed = rows.withColumn("bucket", _bucket("gram", self.buckets)).repartition("bucket").sortWithinPartitions("bucket", "gram", "id")
        placed.write.mode(mode).partitionBy("bucket").parquet(self.path)
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def grams_of(self, query: str) -> list[str]:
        q = query.lower() if self.ignore_case else query
        return sorted({q[i : i + self.n] for i in range(len(q) - self.n + 1)})

    def candidates(self, spark: SparkSession, query: str) -> DataFrame | None:
        """Ids of the texts that hold all grams of a query; None where the query is shorter than a gram."""
        grams = self.grams_of(query)
        if not grams:
            return None
        buckets = sorted({r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket("g", self.buckets)).collect()})
        hits = self.table(spark).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        return hits.groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(grams)).select("id")

    def find(self, texts: DataFrame, id_col: str, text: str, query: str) -> DataFrame:
        """Rows of ``texts`` that contain the query; an empty query matches nothing, one shorter than a gram scans the texts."""
        if not query:
            return texts.where(F.lit(False))
        holds = self._text(text).contains(query.lower() if self.ignore_case else query)
        some = self.candidates(texts.sparkSession, query)
        return texts.where(holds) if some is None else texts.join(some.withColumnRenamed("id", id_col), id_col, "left_semi").where(holds)

    def words(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        """(gram, id) of the grams in ``wanted`` (column gram) only: the index side of a ranking by shared words."""
        w = wanted.select("gram").distinct().withColumn("bucket", _bucket("gram", self.buckets))
        return self.table(spark).join(w, ["bucket", "gram"], "left_semi").select("gram", "id")
