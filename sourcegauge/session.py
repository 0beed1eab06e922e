"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "sourcegauge", **conf: str) -> SparkSession:
    """Session for a laptop, tests and the bench. Clusters bring their own."""
    partitions = str(cpus) if str(cpus).isdigit() else "8"
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # Call sites recorded for every expression cost more than planning does.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shared: dict[tuple[str, str], int] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    A ``file:`` folder may be a mount that all machines share or a folder that each has for its own, where written rows
    would be lost without an error. On a cluster it counts once rows written by tasks all over it are found there again;
    this is tried anew when the cluster has grown.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    local = context.master.startswith("local")
    if folder:
        folder = folder.rstrip("/")
        if not local and _file_system(spark, folder)[0].getUri().getScheme() == "file":
            seen, cores = (context.applicationId, folder), context.defaultParallelism
            if _shared.get(seen, 0) < cores:
                if not _keeps_rows(spark, folder, cores):
                    raise RuntimeError(f"spark.checkpoint.dir is {folder}, a folder of one machine; name one that all executors share")
                _shared[seen] = cores
        return folder
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir().rstrip("/")


def _keeps_rows(spark: SparkSession, folder: str, tasks: int) -> bool:
    """Whether the rows that so many tasks write below ``folder``, one each, are all found again."""
    path = f"{folder}/shared-{uuid.uuid4().hex}"
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        return spark.read.schema("id long").parquet(path).count() == tasks
    finally:
        delete(spark, path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Make a small file appear at ``path`` with all of its text: written under a hidden name, then renamed."""
    system, place = _file_system(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{place.getName()}-{uuid.uuid4().hex}")
    out = system.create(hidden)
    out.write(bytearray(text.encode()))
    out.close()
    if not system.rename(hidden, place):
        raise OSError(f"could not rename {hidden} to {place}")


def delete(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, True)


_owners: list[list[str]] = []


@contextmanager
def frozen_until_done(spark: SparkSession) -> Iterator[None]:
    """Owns the tables frozen inside the block and deletes them at its end: write or collect results before."""
    _owners.append(mine := [])
    try:
        yield
    finally:
        _owners.remove(mine)
        for path in mine:
            delete(spark, path)


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Cuts the lineage, survives lost executors, keeps column pruning for the readers, and
    gives the planner real file sizes: a frozen aggregate is broadcast by Spark's own
    size check (spark.sql.autoBroadcastJoinThreshold) and shuffled when it is larger. The table
    belongs to the innermost ``frozen_until_done``; outside of any it stays.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/frozen/{name}-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
