"""Running queries for many users in one session: a scheduler pool and a tag for each, cancelling by tag, and measures of throughput.

Spark orders the tasks of concurrent queries by their pools; which rows of one query come first is no matter of scheduling here, as every limit has
a total order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession


class QueryService:
    """At most `slots` queries run at a time. Use spark.scheduler.mode=FAIR for pools to share the cores."""

    def __init__(self, spark: SparkSession, slots: int = 4):
        self.spark, self._threads = spark, ThreadPoolExecutor(slots)

    def submit(self, query: Callable[[], DataFrame], pool: str = "default", tag: str | None = None) -> Future:
        """The future rows of a query. The query should end in a limit, as its rows come to the driver."""

        def run() -> list[Row]:
            context = self.spark.sparkContext
            context.setLocalProperty("spark.scheduler.pool", pool)
            if tag:
                context.addJobTag(tag)
            try:
                return query().collect()
            finally:
                if tag:
                    context.removeJobTag(tag)

        return self._threads.submit(run)

    def cancel(self, tag: str) -> None:
        """Stops the jobs of all queries with the tag; their futures raise."""
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def close(self) -> None:
        self._threads.shutdown(wait=True, cancel_futures=True)

    def __enter__(self) -> QueryService:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def throughput(spark: SparkSession, queries: Iterable[Callable[[], DataFrame]], slots: int) -> dict[str, float]:
    """Queries a second and mean seconds from start to end of each, with so many at a time."""

    def timed(query: Callable[[], DataFrame]) -> float:
        began = time.perf_counter()
        query().collect()
        return time.perf_counter() - began

    began = time.perf_counter()
    with ThreadPoolExecutor(slots) as threads:
        taken = list(threads.map(timed, queries))
    return {"queries_per_second": len(taken) / (time.perf_counter() - began), "mean_latency": sum(taken) / max(1, len(taken))}
