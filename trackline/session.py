"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on, plus the adaptive planning the plans rely on, and tasks that list many paths each:
# a batch names up to 10,000 files, and Spark would give every one a task of its own.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}

# What opening a file counts where many are read; a full task of 128 MB then has 2,048 of the smallest.
OPEN_COST = "64k"


def spark_session(app: str = "trackline", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with the required settings; ``conf`` uses ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return require_settings(builder.getOrCreate())


def require_settings(spark: SparkSession) -> SparkSession:
    """Apply the required runtime settings to a session somebody else created."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def _like(spark: SparkSession, key: str, value: str) -> SparkSession:
    """A session like ``spark`` but for one setting. Tables are shared, temporary views and settings are those of now."""
    session = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    session.conf.set(key, value)
    return session


def many_files(spark: SparkSession) -> SparkSession:
    """A session for folders of many small files: a task reads some thousand of them, where Spark's own rule counts 4 MB for
    opening each and so makes a task of every 32. ``spark`` keeps that rule: it decides how all other scans are split.
    """
    return _like(spark, "spark.sql.files.openCostInBytes", OPEN_COST)


def tidy(spark: SparkSession) -> SparkSession:
    """A session whose commands delete their shuffle files as they end, not when the driver happens to collect garbage."""
    return _like(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def in_session(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` as a frame of ``spark``, whichever session it was read in; its scans keep the settings of theirs."""
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """Path below ``spark.checkpoint.dir``, the folder every executor can reach.

    Only a local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="trackline-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return "/".join([base.rstrip("/"), *parts])


def checkpointed(df):
    """Materialise ``df`` in the shared folder, so later jobs all read the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(df: DataFrame) -> None:
    """Delete the checkpoints that ``df`` reads from; neither it nor any other frame can read them after that."""
    sc = df.sparkSession.sparkContext
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        file = leaf.rdd().getCheckpointFile() if leaf.nodeName() == "LogicalRDD" else None
        if file and file.isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
