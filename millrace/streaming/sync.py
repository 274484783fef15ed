"""The sync as a stream: each micro-batch is the same run over a store that a batch job makes."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.model import SOURCES
from millrace.operators.store import Store


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def start_sync(
    raw: DataFrame, store: Store, checkpoint: str, *, now: Callable[[], datetime] = _now, attempts: int = 3,
    sources: tuple[str, ...] | None = SOURCES, trigger: dict | None = None,
) -> StreamingQuery:
    """Start merging a stream of raw records into the store. Late records are audited as conflicts, so there is no watermark.

    A batch that is delivered again after a failure finds its id among the commits and does nothing; one that failed
    before its commit is run anew on the version before. Each batch needs arrivals that are unique in it.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        if store.has_batch(batch_id):
            return
        store.merge(batch, now=now(), attempts=attempts, sources=sources, batch_id=batch_id)

    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
