"""Written stages: cut lineage where a result is costly to redo or is read by several later steps."""
import contextlib
import contextvars
import functools
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOCAL = re.compile(r"local(\[[^\]]*\])?")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a session of one process may fall back to its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not LOCAL.fullmatch(spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = _local_dir()
    return shared.rstrip("/")


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="curbloop-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/curbloop-{name}-{uuid.uuid4().hex}"


_MADE: contextvars.ContextVar = contextvars.ContextVar("stages made inside a tidy block", default=None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: a short plan that survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if _MADE.get() is not None:
        _MADE.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Stages made inside are removed at the end, but for those in which the caller still needs to read: it passes them to the function
    given. Nothing lazy may leave the block without that."""
    made, kept = [], []
    token = _MADE.set(made)
    try:
        yield lambda df: kept.append(tuple(df.inputFiles())) or df
    finally:
        _MADE.reset(token)
        names = {part for files in kept for file in files for part in file.split("/")}
        for path in made:
            if path.rsplit("/", 1)[1] in names:
                if _MADE.get() is not None:
                    _MADE.get().append(path)  # an outer block may remove it
            else:
                remove(spark, path)


_SENT: set = set()


def send_package(spark: SparkSession) -> None:
    """Python workers get the package as a zip file, once an application: also those of a local session started in another folder."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parents[2]
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/curbloop", "zip", root, "curbloop"))
    _SENT.add(app)
