"""Row rules watched while a stream runs: counts per batch and rule, stored."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from stallbook.operators.quality import Rules, keep_valid, violations

SCHEMA = "query string, batch long, rule string, rows long, failed long"


def watch_rules(stream: DataFrame, rules: Rules, name: str = "row_rules") -> DataFrame:
    """Rows that meet every rule; what each batch loses is counted on the way."""
    return keep_valid(stream.observe(name, F.count(F.lit(1)).alias("rows"), *violations(rules)), rules)


class RuleMetrics(StreamingQueryListener):
    """Writes the counts of :func:`watch_rules` as each batch ends.

    A batch has a folder of its own under ``path``, so a batch that is repeated after a
    failure replaces its counts.  Only one row per rule is handled here.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "row_rules"):
        self.spark, self.path, self.name = spark, path, name
        self.ended = threading.Event()
        self.error: Exception | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self.name)
        if seen is None:
            return
        counts = seen.asDict()
        total = counts.pop("rows")
        rows = [(str(progress.id), progress.batchId, rule, total, failed) for rule, failed in counts.items()]
        try:
            counted = self.spark.createDataFrame(rows, SCHEMA).coalesce(1)
            counted.write.mode("overwrite").parquet(f"{self.path}/of={progress.id}-{progress.batchId}")
        except Exception as error:  # the listener's thread has nobody to raise it to
            self.error = error

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def wait(self, seconds: float = 60) -> None:
        """Until the counts of an ended query are written."""
        if not self.ended.wait(seconds):
            raise TimeoutError("the stream's listener has not heard of its end")
        if self.error:
            raise self.error


def stored_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``query``, ``batch``, ``rule``, ``rows``, ``failed`` of all batches so far."""
    return spark.read.schema(SCHEMA).parquet(f"{path}/of=*")


def metrics_by_rule(metrics: DataFrame) -> DataFrame:
    """Sums over all batches, in the columns of ``quality.rule_counts``."""
    sums = metrics.groupBy("rule").agg(F.sum("rows").alias("rows"), F.sum("failed").alias("failed"))
    return sums.select("rule", "rows", (F.col("rows") - F.col("failed")).alias("passed"), "failed")
