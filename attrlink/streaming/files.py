"""Matching files of inputs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.cascade import match_values
from ..plans.prepared import PreparedReference, prepare_reference
from ..session import staged_tables_removed


def match_stream(
    inputs: DataFrame, reference: DataFrame | PreparedReference, path: str, checkpoint: str, **options
) -> StreamingQuery:
    """Match each micro-batch of ``inputs`` against a static reference table.

    The reference is reduced once, when the stream starts, unless it comes prepared; a table that the stream
    prepares itself stays until it is dropped (its name is in the catalog as ``prepared_...``). Every batch goes through
    the batch cascade and is written under its batch id, so a batch that runs again after a failure overwrites its own
    output. What a batch staged is deleted once its output is written. The cascade keeps no state between batches: no
    watermark is needed.
    """
    if not isinstance(reference, PreparedReference):
        reference = prepare_reference(reference, options.get("max_matches", 5), options.get("rules"))

    def run(batch: DataFrame, batch_id: int) -> None:
        with staged_tables_removed(batch.sparkSession):
            results = match_values(batch, reference, **options)
            results.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        inputs.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
