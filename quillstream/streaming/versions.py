"""Streaming twin of versioning: each micro-batch of snapshots is stored with the state that the batches before it left.

The watermark and state layout are choices of this library; late snapshots are processed in the order of arrival, as in the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "article_id string, seq long, content_hash string, version_number int, outcome string"
STATE = "content_hash string, version_number int"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, number = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["observed_at", "seq"], kind="stable")
    hashes = rows["content_hash"]
    before = hashes.shift()
    before.iloc[0] = held
    changed = hashes.ne(before)
    changed.iloc[0] = not number or hashes.iloc[0] != held
    numbers = number + changed.cumsum()
    outcome = changed.map({True: "version-appended", False: "unchanged"})
    if not number:
        outcome.iloc[0] = "created"
    state.update((hashes.iloc[-1], int(numbers.iloc[-1])))
    yield pd.DataFrame({"article_id": key[0], "seq": rows["seq"], "content_hash": hashes, "version_number": numbers.astype("int32"), "outcome": outcome})


def versions_stream(snapshots: DataFrame) -> DataFrame:
    """Stream of snapshots(article_id, content_hash, observed_at, seq) -> stream of OUTPUT."""
    wanted = snapshots.select("article_id", "content_hash", "observed_at", "seq")
    return wanted.groupBy("article_id").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def idempotent_stream(runs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first run of each key within the watermark."""
    return runs.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def start(snapshots: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes the stream of versions as parquet; both folders must be shared by all executors."""
    return versions_stream(snapshots).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").start()
