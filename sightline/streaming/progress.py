"""G3 kept durably: one row per micro-batch in a table.

Spark's progress events have a batch's number and duration; how many messages it
had and frames it kept is told by the batch itself (a batch that is scanned
twice counts its rows twice in the event). A listener puts both together and writes a
folder per batch id, replaced when a batch is repeated, so the table holds
each batch once however often the query was restarted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

_ROW = ("query STRING, batch_id BIGINT, batch_start STRING, n_messages BIGINT, n_kept BIGINT, seconds DOUBLE, "
        "seconds_per_message DOUBLE, n_late BIGINT")


class ProgressTable(StreamingQueryListener):
    """Rows (query, batch_id, batch_start, n_messages, n_kept, seconds,
    seconds_per_message, n_late) of one query's micro-batches under ``path``.

    ``query`` is the name of the table's query, kept over restarts;
    ``n_messages`` of a query that does not report it are those of the event,
    its ``n_kept`` is NULL. ``n_late`` counts what Spark dropped behind the
    watermark. A trigger without data is no
    batch and has no row."""

    def __init__(self, spark: SparkSession, path: str, query: str = "annotation"):
        super().__init__()
        self.spark, self.path, self.query = spark, path.rstrip("/"), query
        self._told: dict[int, tuple[int, int]] = {}

    def batch_done(self, batch_id: int, n_messages: int, n_kept: int) -> None:
        """Told by the batch before its progress event."""
        self._told[batch_id] = n_messages, n_kept

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if "triggerExecution" not in p.durationMs or "addBatch" not in p.durationMs:
            return
        seconds = p.durationMs["triggerExecution"] / 1000.0
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        n, kept = self._told.pop(p.batchId, (p.numInputRows, None))
        row = (self.query, p.batchId, p.timestamp, n, kept, seconds, seconds / n if n else None, late)
        (self.spark.createDataFrame([row], _ROW).coalesce(1)
         .write.mode("overwrite").json(f"{self.path}/batch={p.batchId}"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def read(self) -> DataFrame:
        return self.spark.read.schema(_ROW + ", batch BIGINT").json(self.path).drop("batch")
