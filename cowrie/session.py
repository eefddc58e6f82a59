"""Session factory, table access and the helpers that every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def make_session(app: str = "cowrie", master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benches; a cluster passes its own session to the operators."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    """Tasks that the cluster runs at once."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are slots: files of one row group would else feed one task."""
    want = slots(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def partitions(df: DataFrame, least: int = 0) -> int:
    """Shuffle partitions of the session, or more if the caller asks for more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); on a local master one of our own if it is unset."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.environ.get("COWRIE_LOCAL_SHARED")
    if not made:
        made = os.environ["COWRIE_LOCAL_SHARED"] = tempfile.mkdtemp(prefix="cowrie-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


#: Paths in the shared folder by their last part.
_written: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there is removed when the driver's process ends."""
    name = f"{label}-{uuid.uuid4().hex}"
    path = _written[name] = f"{shared_folder(spark)}/cowrie/{name}"
    atexit.register(_forget, spark, path)
    return path


def drop(*tables: DataFrame) -> None:
    """Removes the tables written by cut that these read: nothing may read them again. Other files stay."""
    for df in tables:
        for name in {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()} & _written.keys():
            _forget(df.sparkSession, _written.pop(name))


#: Removes the shuffle files of a query when it ends, instead of when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str = "t", free: bool = False, codec: str | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: its lineage ends there and it
    survives the loss of executors. The table is removed by drop or when the driver's process ends. free: the shuffles
    that made it are removed at once. codec: how it is compressed, if not as the session does."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(_FREE, None)
    try:
        if free:
            spark.conf.set(_FREE, "true")
            df = df.select("*")  # planned under the setting
        df.write.parquet(path, compression=codec)
    finally:
        if free:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)
