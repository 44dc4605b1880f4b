"""Import of cleaned invoice files as they arrive in a folder.

The same merge as the batch import runs once per micro-batch. The merge is keyed, and every
output of a batch is named by its batch id, so a repeated batch gives the same tables.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.importing import DEFAULT_AS_OF
from ..plans.import_job import import_rows
from ..schemas import CLEAN_INVOICE_COLUMNS, text_schema
from ..sources.tables import TableStore


def stream_imports(
    store: TableStore, folder: str, checkpoint: str, as_of: str = DEFAULT_AS_OF
) -> StreamingQuery:
    """Import all files waiting in the folder, then stop; run it again for later ones."""
    rows = (
        store.spark.readStream.schema(text_schema(CLEAN_INVOICE_COLUMNS))
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(folder)
    )

    def merge(batch: DataFrame, batch_id: int) -> None:
        # The query's id tells streams apart, and one that starts anew from its own earlier runs.
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        run = f"stream-{query}-{batch_id}"
        numbered = batch.withColumn("row_number", F.monotonically_increasing_id())
        staged = store.stage(numbered, "read", run)
        moment = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
        import_rows(store, staged, as_of, F.lit(moment).cast("timestamp"), run)

    return (
        rows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
