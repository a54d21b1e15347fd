"""Session helpers: table access and lineage cuts in the folder shared by all executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from phylolake.errors import NoSharedFolder

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_written: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the release stored under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read and write.

    A cluster names it in ``spark.checkpoint.dir``. Where that setting is
    absent, a session on one machine uses a temporary folder of this driver; on a cluster, whose executors could not
    see it, :class:`NoSharedFolder` is raised.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors can read and write")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="phylolake-")
    return _own_dirs[app]


def spill(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table read back.

    This cuts the lineage and survives the loss of executors. The files go away
    with :func:`discard` or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phylolake-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._phylolake_path = path
    return out


def once(spark: SparkSession, name: str, make) -> DataFrame:
    """The table ``make()`` gives, written once per session and read back from then on; made again if its files have gone."""
    key = (spark.sparkContext.applicationId, name)
    held = _written.get(key)
    if held is not None:
        fs, p = _fs(spark, held._phylolake_path)
        if fs.exists(p):
            return held
    made = make()
    _written[key] = made if hasattr(made, "_phylolake_path") else spill(made, "once")
    return _written[key]


def forget_later(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver's JVM ends."""
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)


def discard(*tables: DataFrame) -> None:
    """Delete spilled tables that no plan reads any more."""
    for t in tables:
        path = getattr(t, "_phylolake_path", None)
        if path:
            fs, p = _fs(t.sparkSession, path)
            fs.delete(p, True)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def require_columns(df: DataFrame, *names: str) -> None:
    """Fail on the driver, with the missing names, before a plan is built."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Every operator that runs Python on executors calls this first, so nothing has
    to be installed there.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.parent.suffix != ".zip":
        target = Path(tempfile.mkdtemp(prefix="phylolake-")) / "phylolake_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def work_slots(spark: SparkSession) -> int:
    """Partitions that keep all cores busy with work that is heavy per row."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread_work(df: DataFrame) -> DataFrame:
    """``df`` in enough partitions for heavy work per row; a scan that has them already is not moved."""
    spark = df.sparkSession
    return df if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else df.repartition(work_slots(spark))
