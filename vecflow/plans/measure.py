"""What a piece of work costs: wall-clock seconds, and the execution memory that Spark reports for its stages."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import SparkSession

T = TypeVar("T")


def measured(spark: SparkSession, work: Callable[[], T]) -> tuple[T, float, float]:
    """The result of ``work``, its seconds, and the kilobytes of the stage that took most execution memory over its tasks.

    The jobs that ``work`` starts carry a tag. Memory is what Spark's tasks report (sorts, hash tables, joins), not that of
    Python workers; work without jobs has 0.
    """
    context, tag = spark.sparkContext, f"vecflow-{uuid.uuid4().hex}"
    context.addJobTag(tag)
    start = time.perf_counter()
    try:
        result = work()
    finally:
        context.removeJobTag(tag)
    return result, time.perf_counter() - start, peak_kilobytes(context, tag)


def peak_kilobytes(context: SparkContext, tag: str) -> float:
    """Largest sum over the tasks of a stage among the jobs of a tag; stages that were skipped or forgotten count nothing."""
    jvm = context._jsc.sc()
    tracker, store, most = jvm.statusTracker(), jvm.statusStore(), 0
    for job in tracker.getJobIdsForTag(tag):
        info = tracker.getJobInfo(job)
        for stage in info.get().stageIds() if info.isDefined() else ():
            try:
                most = max(most, store.lastStageAttempt(stage).peakExecutionMemory())
            except Py4JJavaError:
                continue
    return most / 1024
