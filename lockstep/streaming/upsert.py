"""Upsert a stream into a table, batch by batch."""

from pyspark.sql import DataFrame

from lockstep.sources import snapshots
from lockstep.streaming.ingest import applied, marker, run_batches


def upsert_stream(
    stream: DataFrame,
    root: str,
    table: str,
    keys: list[str],
    checkpoint: str,
    sequence: str | None = None,
) -> None:
    """Merge every waiting micro-batch into ``table`` by ``keys`` and stop.

    With ``sequence``, a column of the rows, a batch may hold several updates of a key in any order: the highest
    one stands, and rows that come later with a lower one lose. Without it a batch has one row per
    key, and two are an error that each restart meets again.

    The commit carries the stream's id, which Spark keeps in its checkpoint, and the batch id; a batch
    replayed after a failure finds them and is skipped. Any other stream's batches are merged.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        mark = marker(batch, batch_id)
        if not applied(batch.sparkSession, root, table, mark):
            snapshots.merge(batch, root, table, keys, None, mark, sequence)

    run_batches(stream, checkpoint, handle)
