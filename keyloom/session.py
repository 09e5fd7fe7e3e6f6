"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_SCRATCH: dict[str, str] = {}
#: Folders that steps have written since ``settled_alone`` began.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)

# Settings the plans in this package are written for.  Partition counts are left
# to adaptive execution so the same job fits one machine or a large cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Holds while a step is written that frees its shuffles: texts reach Python in batches of some MB.
STEP_SETTINGS = {SHUFFLE_CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the package's settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "keyloom", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, used for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the session
    runs on one machine, as in tests, a fresh temporary folder is made, and removed at the end.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="keyloom-")
        atexit.register(shutil.rmtree, _SCRATCH[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_SCRATCH[app])
    return _SCRATCH[app]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that nothing has used yet."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def small_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A table of metadata rows, handed to Spark as a local relation.

    Unlike rows parallelised from Python, its size is known to the optimiser, so joins with
    it broadcast and projections over it fold away.
    """
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def settled(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a (small) intermediate once to the shared scratch folder and read it back.

    Later uses do not repeat the work, survive lost executors, and the file size tells the
    optimiser what it may broadcast.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_clean(df: DataFrame, label: str = "step") -> DataFrame:
    """``settled``, after which what the step has shuffled is removed from the executors' disks.

    Long rounds of steps would otherwise keep the shuffles of all of them until the driver collects garbage.
    """
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in STEP_SETTINGS}
    for key, value in STEP_SETTINGS.items():
        conf.set(key, value)
    try:
        return settled(df, label)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def settled_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str = "step") -> DataFrame:
    """``settled_clean`` of the table that ``make`` gives, after which the steps that ``make`` has written are removed.

    Nothing but the table may go on reading them.
    """
    token = _WRITTEN.set(written := [])
    try:
        try:
            df = make()
        finally:
            _WRITTEN.reset(token)
        return settled_clean(df, label)
    finally:
        for path in written:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
