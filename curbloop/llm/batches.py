"""Memory of Python tasks."""
from pyspark.sql import DataFrame

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
LIMIT = 4 << 20


def mapped(rows: DataFrame, function, schema) -> DataFrame:
    """``rows.mapInArrow``, with batches bounded in bytes and not only in rows: a batch of long texts could exceed a worker's memory.

    The limit is a session setting that counts when the plan runs, so it is set for the session unless it has a smaller one."""
    conf = rows.sparkSession.conf
    now = conf.get(KEY, None)
    if not now or not now.isdigit() or not 0 < int(now) <= LIMIT:
        conf.set(KEY, str(LIMIT))

    def run(batches):
        yield from function(batches)
        release()

    return rows.mapInArrow(run, schema)


def release() -> None:
    """Give unused memory back: a worker waits for its next task, maybe of another stage, with all it has."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
