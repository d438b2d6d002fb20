"""Shared staging folder and size-checked broadcasts.

Intermediate tables that cut lineage are Parquet folders below ``spark.checkpoint.dir``, the folder that a
cluster shares between its executors, so a lost executor costs a re-read and nothing else. They go when the
application ends.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a checked side may be broadcast, far below executor memory; bytes that a column takes at least.
BROADCAST_BYTES, COLUMN_BYTES = 48_000_000, 16
#: Bytes of rows up to which Spark itself may broadcast a side that it has computed.
MEASURED = "4m"

_folders: dict[str, str] = {}
#: Folders of the jobs that are being built; tables go to the innermost one.
_open_jobs: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the cluster's shared one. Where that is not set, a local folder, on a local master only."""
    context = spark.sparkContext
    if context.applicationId not in _folders:
        found = context.getConf().get("spark.checkpoint.dir", None)
        if not found and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = found.rstrip("/") if found else f"file://{tempfile.mkdtemp(prefix='facetline-')}"
        path = context._jvm.org.apache.hadoop.fs.Path(f"{base}/facetline-{context.applicationId}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        _folders[context.applicationId] = path.toString()
    return _folders[context.applicationId]


@contextlib.contextmanager
def job_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder below the shared one that takes the tables written meanwhile."""
    _open_jobs.append(f"{shared_dir(spark)}/job-{name}-{uuid.uuid4().hex}")
    try:
        yield _open_jobs[-1]
    finally:
        _open_jobs.pop()


def job_of() -> str | None:
    """The folder of the job that is being built, if any."""
    return _open_jobs[-1] if _open_jobs else None


@contextlib.contextmanager
def within(folder: str | None) -> Iterator[None]:
    """Tables written meanwhile go to the folder of that job; without one, where they would go."""
    if folder is not None:
        _open_jobs.append(folder)
    try:
        yield
    finally:
        if folder is not None:
            _open_jobs.pop()


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it. Empty frames keep their schema."""
    path = f"{_open_jobs[-1] if _open_jobs else shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _variable(df: DataFrame) -> list[Column]:
    """Bytes of the columns whose width follows their values."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            out.append(F.octet_length(c))
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            out.append(F.octet_length(F.to_json(F.struct(c))))
    return out


def measured_joins(spark: SparkSession) -> None:
    """From now on the session's joins broadcast what was measured: hinted sides, and what Spark finds to be small once it has been computed.

    A side made from a small file by expansion, as texts into tokens, or read from a well compressed table, is estimated far below what it
    takes, and would go whole through the driver. Results are planned when they are asked for, so the setting stays.
    """
    if spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1":
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", MEASURED)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its values take at most ``most`` bytes; beyond, Spark shuffles it as usual.

    Give it a materialised frame: it is measured here and read again by the join.
    """
    width = COLUMN_BYTES * len(df.columns)
    rows = most // width
    total = F.lit(0)
    for c in _variable(df):
        total = total + F.coalesce(c, F.lit(0))
    n, more = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(total.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and n * width + more <= most else df
