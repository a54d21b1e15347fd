"""Structured Streaming: reference counts kept up to date, and windowed event counts.

The batch operators take whole tables; these keep their results current while
deliveries arrive, with the same semantics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phylolake.operators import orphans


class OrphanMonitor:
    """Signed reference and existence counts per key, maintained from streams of deltas.

    Each micro-batch is folded into the state table under ``folder`` with
    :func:`orphans.apply_deltas`; versions are written side by side and named by
    batch, so a replayed batch is recognised.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.version = self._latest()

    def _latest(self) -> int | None:
        """Newest complete version in the folder, so a restarted driver goes on where it stopped."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state-*/_SUCCESS")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        names = [f.getPath().getParent().getName() for f in found or []]
        return max((int(n.rpartition("-")[2]) for n in names), default=None)

    def _path(self, version: int) -> str:
        return f"{self.folder}/state-{version:012d}"

    def fold(self, deltas: DataFrame, version: int) -> None:
        """Write state ``version`` from the latest one before it and the deltas."""
        if self.version is not None and version <= self.version:
            return  # a replayed batch is already in the state
        orphans.apply_deltas(self.state(), deltas).write.mode("overwrite").parquet(self._path(version))
        self.version = version

    def state(self) -> DataFrame | None:
        return None if self.version is None else self.spark.read.parquet(self._path(self.version))

    def report(self) -> DataFrame | None:
        """Current orphans per space and period."""
        s = self.state()
        return None if s is None else orphans.orphan_keys(s).groupBy("space", "period").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("refs").alias("n_refs"))

    def start(self, deltas: DataFrame, checkpoint: str) -> StreamingQuery:
        """Process all deltas available in a stream of (space, period, key, refs, present)."""
        return deltas.writeStream.foreachBatch(lambda df, i: self.fold(df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", value: str = "value", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, kind, n, total) per tumbling window; events later than ``late`` are dropped on a stream."""
    t = events.withColumn("__t", F.col(time).cast("timestamp"))
    return (
        t.withWatermark("__t", late).groupBy(F.window("__t", window).alias("w"), F.col(kind).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), "kind", "n", "total")
    )


def session_counts(events: DataFrame, *, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, session_start, n): bursts of events of a user without a longer gap."""
    t = events.withColumn("__t", F.col(time).cast("timestamp"))
    return (
        t.withWatermark("__t", late).groupBy(F.session_window("__t", gap).alias("w"), F.col(user).alias("user"))
        .agg(F.count(F.lit(1)).alias("n")).select("user", F.col("w.start").alias("session_start"), "n")
    )
