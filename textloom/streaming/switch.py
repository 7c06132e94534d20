"""Monitor of a requested switch: READY, PASS or FAIL for each key, emitted when it changes.

An event carries the current and the requested value. PASS, once reached, stays: the current value became
the target, by request, after another one. A request that is not met for `patience` events is FAIL.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

OUT = "user_id long, event_id long, status string"
_STATE = "previous string, ticks int, status string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: tuple, current: str, requested: str, target: str, patience: int = 4) -> tuple[tuple, str | None]:
    """Next state and the status if it is to be emitted."""
    previous, ticks, last = state
    if last == "PASS":
        return state, None
    if current == requested == target and previous is not None and previous != target:
        status = "PASS"
    elif requested == target and current != target:
        ticks += 1
        status = "FAIL" if ticks >= patience else "READY"
    else:
        ticks, status = 0, "READY"
    return (current, ticks, status), status if status != last else None


def _run(rows: Iterable[tuple], state: tuple, target: str, patience: int) -> tuple[tuple, list[tuple]]:
    out = []
    for event, current, requested in rows:
        state, said = step(state, current, requested, target, patience)
        if said:
            out.append((event, said))
    return state, out


def monitored(events: DataFrame, target: str, *, patience: int = 4) -> DataFrame:
    """OUT of events (user_id, event_id, current, requested), in order of event_id."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("event_id")
        _, out = _run(zip(frame["event_id"], frame["current"], frame["requested"]), (None, 0, None), target, patience)
        return pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": [e for e, _ in out], "status": [s for _, s in out]})

    return events.groupBy("user_id").applyInPandas(run, OUT)


def monitored_stream(events: DataFrame, target: str, *, patience: int = 4) -> DataFrame:
    """The same over a stream whose events come in order of event_id."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values("event_id")
        now, out = _run(zip(frame["event_id"], frame["current"], frame["requested"]), state.get if state.exists else (None, 0, None), target, patience)
        state.update(now)
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": [e for e, _ in out], "status": [s for _, s in out]})

    return events.groupBy("user_id").applyInPandasWithState(run, OUT, _STATE, "append", "NoTimeout")


def run_stream(spark: SparkSession, source: str, schema, prepare, target: str, out: str, checkpoint: str, *, files_per_batch: int = 1) -> DataFrame:
    """monitored_stream() over the Parquet files at `source`, appended to `out`."""
    stream = prepare(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    query = monitored_stream(stream, target).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
