"""Requests as a stream, one run per accepted message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from dossier.operators.requests import ingest, validate


def stream_requests(messages: DataFrame) -> DataFrame:
    """Validated requests of a message stream, rejects included."""
    return validate(ingest(messages))


def run_requests(messages: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch of accepted requests to ``run(requests, batch_id)``.

    Returns the started query.  A batch may be handed over again after a failure, with
    the same id, so ``run`` should overwrite by id."""

    def batch(requests: DataFrame, batch_id: int) -> None:
        run(requests.where("accepted").drop("accepted", "error"), batch_id)

    return (
        stream_requests(messages)
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
