"""Continuous copies: decode at the source's registry, encode under the target's own policy.

Packing is a stateless projection, so it goes into any stream; one micro-batch is one write action: it
sees one snapshot of the registry, and a slot that is missing warns once in it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from stowage.functions.packing import unpack
from stowage.registry import Registry
from stowage.sources.tables import PackedTable, packed_columns


def replicate(stream: DataFrame, target: PackedTable, checkpoint: str, source_registry: Registry | None = None, kinds: dict[str, str] | None = None, **trigger):
    """Starts a query that appends a stream of packed rows to a table under the table's own policies.
    ``kinds``: the packed columns, where the stream's metadata does not name them. A micro-batch is one part
    of the table, named by the checkpoint and its number: one that runs again after a failure replaces
    what it had written."""
    kinds = kinds or {c: kind for c, (kind, _) in packed_columns(stream).items()}

    stream_id = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def copy(batch: DataFrame, number: int) -> None:
        if source_registry is not None:
            source_registry.reload()
        plain = batch.select(*[unpack(batch[c], kinds[c], source_registry).alias(c) if c in kinds else batch[c] for c in batch.columns])
        target.write(plain, part=f"{stream_id}-{number}")

    return stream.writeStream.foreachBatch(copy).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
