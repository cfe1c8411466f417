"""Tables and sizes that operators share: materialised steps and data-driven partition counts."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: An estimate above this is Spark's "unknown".
_UNKNOWN = 1 << 55


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session, else the checkpoint folder that its context was given.

    Only where neither names one, and all executors are threads of this machine (tests, a laptop), a temporary folder is made; a
    cluster without a shared folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="kindred-")
    spark.sparkContext.setCheckpointDir(own)
    atexit.register(_remove_local, own[len("file://") :])
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


#: Tables written and not yet deleted, by path; what is left of them goes when the application ends.
_live: dict[str, SparkSession] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: lineage ends here and survives lost executors.

    ``discard`` deletes it, or the end of the ``scratch`` it was made in, or else the end of the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _live[path] = spark
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._kindred_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a materialised table whose last reader has finished."""
    path = getattr(df, "_kindred_path", None)
    if path:
        _delete(path)


def _delete(path: str) -> None:
    spark = _live.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch() -> Iterator[set[str]]:
    """Deletes at its end the tables made within it, but for those whose paths are added to the set it gives.

    For callers that write or count a result: a lazy result may read such tables until then.
    """
    before, kept = set(_live), set()
    try:
        yield kept
    finally:
        for path in set(_live) - before - kept:
            _delete(path)


@atexit.register
def _clean_up() -> None:
    for path in list(_live):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may be over, and its folder with it
            return


def size_hint(df: DataFrame) -> int | None:
    """Catalyst's estimate of ``df`` in bytes (file sizes for scans), None if it has none. For sizing only."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if estimate >= _UNKNOWN else estimate


def slots_for(df: DataFrame, bytes_per_slot: int) -> int:
    """How many groups to split work over ``df`` into, so that each stays near ``bytes_per_slot`` of input."""
    hint = size_hint(df)
    if hint is None:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(hint / bytes_per_slot))
