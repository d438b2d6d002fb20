"""The most recent results of index jobs, kept by what they were built from.

A job is what one build writes: all tables that it stages lie in one folder below the shared one. The ``KEEP`` jobs that
were asked for last stay; when another comes, the least recent one is forgotten and its folder goes, so whoever holds its
tables longer than that reads nothing. A job is known by its name and by a stamp of its sources, so that a table that has
changed is another snapshot.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from facetline.operators import staging

#: Jobs that stay.
KEEP = 4

_jobs: dict[str, OrderedDict[tuple, tuple[str, Any]]] = {}


def stamp(spark: SparkSession, *paths: str) -> tuple:
    """Names, lengths and times of change of the files at each path, and one level below it."""
    context, out = spark.sparkContext, []
    for p in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        out += [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in system.listStatus(path)]
    return tuple(sorted(out))


def recent(spark: SparkSession, name: str, snapshot: tuple, build: Callable[[], Any], keep: int = KEEP) -> Any:
    """What ``build()`` returned for this name and snapshot, built now unless it is among the ``keep`` most recent jobs of the application."""
    jobs, key = _jobs.setdefault(spark.sparkContext.applicationId, OrderedDict()), (name, snapshot)
    if key in jobs:
        jobs.move_to_end(key)
        return jobs[key][1]
    with staging.job_folder(spark, name) as folder:
        jobs[key] = folder, build()
    while len(jobs) > keep:
        _, (old, _) = jobs.popitem(last=False)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return jobs[key][1]


def known(spark: SparkSession) -> list[tuple]:
    """(name, snapshot) of the jobs that stay, the least recent one first."""
    return list(_jobs.get(spark.sparkContext.applicationId, ()))
