"""Session helpers: where intermediate tables live, and how they are written and read back."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once, unless their Python path has it already."""
    app, top = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app not in _SHIPPED and str(top.parent) not in on_path:
        path = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_base(spark)}/corpusloom/{name}-{uuid.uuid4().hex[:12]}"


#: Scratches that own what is materialized, the innermost last, and tables that no scratch deletes.
_OPEN: list[Scratch] = []
_KEPT: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage (a lost executor costs no recomputation beyond this table) and gives the planner true
    sizes. Within an open ``Scratch`` that ``owns`` what is written the table is deleted with it; others
    stay for the results that are read from them, until ``sweep`` or the end of the driver.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    if _OPEN:
        _OPEN[-1].paths.append(path)
    else:
        _KEPT.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep() -> None:
    """Delete the intermediate tables of all results so far; those not yet written out cannot be read after it."""
    while _KEPT:
        spark, path = _KEPT.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            discard(spark, path)


atexit.register(sweep)


class Scratch:
    """Intermediate tables of one operator, deleted once its result no longer needs them.

    ``with Scratch(spark) as s: ... return s.result(df, name)`` writes tables with ``s.table``; the result
    is written too, and stays. If the operator fails, its tables go as well. One that ``owns`` also deletes
    what is materialized meanwhile, by whatever the operator calls.
    """

    def __init__(self, spark: SparkSession, owns: bool = False):
        self.spark, self.paths, self.owns = spark, [], owns

    def __enter__(self) -> Scratch:
        if self.owns:
            _OPEN.append(self)
        return self

    def __exit__(self, *_) -> None:
        if self.owns:
            _OPEN.remove(self)
        discard(self.spark, *self.paths)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = new_dir(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """A table that outlives this scratch, for whoever opened it."""
        at = _OPEN.index(self) if self.owns else len(_OPEN)
        inner = _OPEN[at:]
        del _OPEN[at:]
        try:
            return materialize(df, name)
        finally:
            _OPEN.extend(inner)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders below the shared folder through Spark's own file systems; missing ones do no harm."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def merge_join(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A shuffled sort-merge join, whatever the planner believes about sizes; AQE splits its skewed keys."""
    return a.hint("merge").join(b.hint("merge"), on, how)


#: A side is broadcast if its files hold no more bytes and rows than these.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 1_000_000


def _written_bytes(df: DataFrame) -> int | None:
    """Bytes of the files behind ``df``, if it is nothing but some columns of a table as it was written."""
    p = df._jdf.queryExecution().optimizedPlan()
    while p.getClass().getSimpleName() == "Project":
        p = p.child()
    return int(str(p.stats().sizeInBytes())) if p.getClass().getSimpleName() == "LogicalRelation" else None


def small_join(a: DataFrame, b: DataFrame, on, how: str = "inner", most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join with ``b`` broadcast if its files are at most ``most_bytes`` and ``most_rows``, else by merging.

    Unless ``b`` is a written table already it is written first, so it is computed once and judged by
    what it is. Its rows are counted from the files' footers.
    """
    size = _written_bytes(b)
    if size is None:
        b = materialize(b, "small-side")
        size = _written_bytes(b)
    if size <= most_bytes and b.count() <= most_rows:
        return a.join(b.hint("broadcast"), on, how)
    return merge_join(a, b, on, how)


#: Tables of fewer bytes, as their files say, are dealt to all cores.
SMALL_TABLE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan of a small table dealt to all cores: one small file is one row group, and that one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if n > 1 and size < SMALL_TABLE else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
