"""The retry budget as keyed state: failures since the last success, in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key long, failures long, state string"


def step(failures: int, successes: int, kinds: list[str], failure: str, success: str) -> tuple[int, int]:
    for k in kinds:
        if k == success:
            failures, successes = 0, successes + 1
        elif k == failure:
            failures += 1
    return failures, successes


def state_of(failures: int, successes: int, most: int) -> str:
    return "failed" if failures >= most else "pending" if failures else "indexed" if successes else "pending"


def fold_stream(states: DataFrame, out: str, checkpoint: str):
    """Runs over what is there; each micro-batch's states are written under its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_states(events: DataFrame, key: str, kind: str, order: str, failure: str, success: str, most: int) -> DataFrame:
    """One row per key and micro-batch with its state so far."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        now = step(*(state.get if state.exists else (0, 0)), rows[kind].tolist(), failure, success)
        state.update(now)
        yield pd.DataFrame({"key": [k[0]], "failures": [now[0]], "state": [state_of(*now, most)]})

    return events.groupBy(key).applyInPandasWithState(fold, OUT, "failures long, successes long", "update", GroupStateTimeout.NoTimeout)
