"""Session defaults. Nothing here overrides what a cluster has already set, but shuffles get more partitions for large input."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "trailweave", partitions: str = "8") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Parquet bytes of input for each shuffle partition: a row takes some 20 to 40 times its parquet size when several sorts of one task hold it.
PARTITION_BYTES = 4 << 20
# Shuffled bytes up to which adaptive execution joins partitions; its own 64 MB of well compressed ids are gigabytes when a task sorts them.
JOINED_BYTES = 16 << 20
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def fit_partitions(spark: SparkSession, folder: str) -> int:
    """Raises ``spark.sql.shuffle.partitions`` to one for every ``PARTITION_BYTES`` of the folder, so that a task's share does not grow with the input.

    A higher setting stays, and adaptive execution still joins small partitions, to at most ``JOINED_BYTES`` unless a size is set.
    """
    if spark.conf.get(ADVISORY, None) is None:
        spark.conf.set(ADVISORY, str(JOINED_BYTES))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


_ROOTS: dict[str, str] = {}


def _scratch_root(spark: SparkSession) -> str:
    """The session's own folder for written tables, removed when the driver's JVM ends.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``. A session on a
    ``local[...]`` master, whose tasks all see the driver's disk, may leave that unset; any other must set it.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.gettempdir()
        root = f"{base.rstrip('/')}/trailweave-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS[app] = str(files.makeQualified(path).toString())
    return _ROOTS[app]


def scratch_dir(spark: SparkSession) -> str:
    """The name of a new folder for one written table."""
    return f"{_scratch_root(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared folder and read back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Unlike a checkpoint, the
    written table keeps its size for the planner, so small tables are broadcast by size, and later
    scans read only the columns they need. A lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = scratch_dir(spark) + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for a table that nothing reads any more; loops would else keep every round's tables until the session ends."""
    spark = table.sparkSession
    root = _scratch_root(spark)
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if str(files.makeQualified(path).toString()).startswith(root + "/"):
            files.delete(path, True)
