"""Progress of a running job, followed in its growing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.operators import report
from lodeflow.sources.log_tail import RANGE_BYTES, tail_logs


def progress_stream(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A streaming table of each stage's last state in the logs at path, see report.audit_progress.

    The last line wins, by file name and then by its place in the file, whatever its numbers are: a total that shrinks is
    told as it is. State is a row for each stage and is kept in the query's checkpoint, as are the bytes read of each file.
    Write it in complete or update mode.
    """
    lines = tail_logs(spark, path, range_bytes)
    return report.audit_states(lines.select(F.struct("file", "at").alias("order"), "line"), "order")
