"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on.  Skew handling is forced because a
# lookup side keyed by tail, part or station may hold a third of all rows.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Larger generated methods are never compiled by the JVM and run several times slower.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Work tables are mostly keys and times; this takes about two thirds of the disk of the default.
COMPRESSION = "zstd"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL_DIRS: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that the caller has not set; UTC always, since results depend on it."""
    given = spark._jsparkSession.sessionState().conf()
    for key, value in SETTINGS.items():
        if key == "spark.sql.session.timeZone" or not given.contains(key):
            spark.conf.set(key, value)
    return spark


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skyledger")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        # Stack traces per column call cost more than planning itself.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local folder would lose data with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="skyledger-")
    return _LOCAL_DIRS[sc.applicationId]


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for one run below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is shuffled for a table written inside goes as soon as the table stands, and not when the driver collects its garbage."""
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, cutting its lineage.

    A lost executor then costs one read, not the whole history, and later steps
    read only the columns they use.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(path, compression=COMPRESSION)
    return spark.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """Like `settle`, in buckets of `key`: joins by it shuffle their other side only."""
    spark = df.sparkSession
    name, parts = f"skyledger_{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(parts, key).write.format("parquet").bucketBy(parts, key)
    with shuffles_dropped(spark):
        writer.option("path", run_dir(spark, label)).option("compression", COMPRESSION).saveAsTable(name)
    kept = spark.table(name)
    # The frame knows its files and buckets; the catalog keeps no entry of a work table.
    spark.sql(f"DROP TABLE {name}")
    return kept
