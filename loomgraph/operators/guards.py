"""Guards on work: checks of counts before a step, and a deadline that cancels a session's jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class WorkStopped(RuntimeError):
    """Work that did not go on; ``reason`` says why."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def within(df: DataFrame, most: int, reason: str) -> DataFrame:
    """``df`` itself, if it has at most ``most`` rows; counting stops at one more. The answer depends on the data only."""
    if df.limit(most + 1).count() > most:
        raise WorkStopped(reason)
    return df


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancel the jobs that this block still runs after ``seconds``; the block then raises WorkStopped("deadline")."""
    tag, late = f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise WorkStopped("deadline") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
