"""Sessions, table reading and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "tidewrack", cpus: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the driver's parquet tables, pruned to ``columns`` at the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over as many partitions as there are tasks to run at once, by ``by`` if given.

    For small rows that are much work each: adaptive coalescing goes by bytes and
    would put them all into one task.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local, as in tests, a temporary folder
    is made; on a cluster without the setting there is none that all share, an error.
    """
    conf = spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"{CHECKPOINT_KEY} is not set: a cluster needs a folder that all its executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidewrack-")
    return _own[app]


class Scratch:
    """Written tables under the shared folder that cut lineage.

    ``keep`` writes a frame as parquet and returns it read back, so what follows
    neither recomputes it nor depends on any executor. ``drop`` deletes a
    superseded one; all that is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.clear)

    def keep(self, df: DataFrame, *measures: Column) -> DataFrame:
        """``df`` written and read back; ``measures``, aggregates named by alias, are taken on the way into ``measured``."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        seen = Observation()
        rows = F.count(F.lit(1)).alias("rows")
        df.observe(seen, rows, *measures).write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._tidewrack_path = path
        kept.measured = {k: v or 0 for k, v in seen.get.items()}
        return kept

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_tidewrack_path", None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
