"""Tables that driver and executors share between the steps of a job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_JOB: ContextVar[str] = ContextVar("job", default="steps")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session's
    ``spark.checkpoint.dir`` names. Only where that is unset and the master is local (tests
    on one machine) a local folder is made and set; it goes when Python ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir: executors of {master} share no local folder with the driver")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        root = "file://" + path
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{_JOB.get()}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage so that a lost executor costs the reread of a file and not
    the work before it, and so that later steps see one set of rows. The
    files stay until the ``job`` around them ends, else until the shared folder is cleared.
    """
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def job(spark: SparkSession, name: str = "job") -> Iterator[None]:
    """Steps written inside lie in a folder of their own, which is removed at the end. Results
    read those steps, so write them out before."""
    own = f"{name}-{uuid.uuid4().hex}"
    before = _JOB.set(own)
    try:
        yield
    finally:
        _JOB.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{own}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
