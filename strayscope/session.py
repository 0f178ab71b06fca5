"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "strayscope",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on and the UI off; on a cluster ``master`` stays None."""
    builder = SparkSession.builder.appName(app)
    if master:
        # local mode: the driver JVM is the only executor, give it the heap
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("STRAYSCOPE_DRIVER_MEMORY", "16g"))
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure_session(spark)
    ensure_checkpoint_dir(spark)
    return spark


def configure_session(spark: SparkSession) -> None:
    """Runtime SQL settings the plans rely on: AQE with skew-join splitting,
    and broadcast joins decided only from measured (not estimated) sizes."""
    for k, v in (("spark.sql.adaptive.enabled", "true"),
                 ("spark.sql.adaptive.skewJoin.enabled", "true"),
                 ("spark.sql.autoBroadcastJoinThreshold", "-1"),
                 ("spark.sql.execution.arrow.pyspark.enabled", "true"),
                 ("spark.sql.execution.arrow.maxRecordsPerBatch", "4096"),
                 ("spark.sql.adaptive.autoBroadcastJoinThreshold", str(32 << 20))):
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is
    unset (local tests) create a private scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="strayscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/strayscope-io/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: ``df`` as Parquet in the shared folder, read back."""
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(df: DataFrame) -> list[str]:
    """The files of a ``written`` table in the shared folder, for tasks that look things up in all of it."""
    return df.inputFiles()


def dropped(df: DataFrame) -> None:
    """Remove the files of a ``written`` table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``strayscope`` importable in Python workers (which do not inherit the
    driver's sys.path): zip the package once and ``addPyFile`` it; Spark's file
    server distributes it to every executor."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="strayscope-pkg-"), "strayscope.zip")
    with zipfile.ZipFile(out, "w") as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
