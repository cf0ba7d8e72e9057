"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.errors import InvalidOperation

#: Settings the engine relies on for its semantics; everything else is the cluster's business.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's semantic settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config(map=SEMANTIC_CONF)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster without it is an error, since a
    machine-local folder would be invisible to the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise InvalidOperation("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Workspace:
    """A private sub-folder of the shared folder holding the written tables of one iterative job.

    A written table cuts lineage, survives the loss of executors and, unlike an RDD checkpoint, gives the optimizer real
    size statistics, so that it can decide by size whether a join side may be broadcast. A frame read from it stays valid until
    :func:`release` is called or the driver's process ends, which both remove the folder.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _open.append(self)

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        target = f"{self.path}/{name}"
        df.write.options(**options).mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, name: str | None = None) -> None:
        """Remove a table that nothing reads any more, or the whole folder."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_open: list[Workspace] = []


def release() -> None:
    """Remove the written tables of all operators run so far; frames that read them are no longer valid."""
    while _open:
        work = _open.pop()
        try:
            work.drop()
        except Exception:  # the session has ended before; its folder is the cluster's to clean
            continue


atexit.register(release)
