"""Streams: triage decisions as they arrive, and files as they appear."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def next_state(state: str | None, action: str) -> str | None:
    """The same action twice clears, another replaces, ``undo`` clears."""
    return None if action == "undo" or action == state else action


def triage_states(actions: DataFrame) -> DataFrame:
    """(name, state) updates from a stream of (name, ts, event_id, action); state is kept by name in the state store.

    Events of one batch are taken in time order; earlier batches come first.
    Start it with output mode ``update``.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for action in rows["action"]:
            now = next_state(now, action)
        state.update((now,))
        yield pd.DataFrame({"name": [key[0]], "state": [now or "undecided"]})

    kind = dict(actions.dtypes)["name"]
    return actions.groupBy("name").applyInPandasWithState(step, f"name {kind}, state string", "state string", "update", "NoTimeout")


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """New files of a folder, each read once; run it with ``availableNow`` to do what is there and stop."""
    return spark.readStream.format(fmt).schema(schema).load(path)


def build_new(spark: SparkSession, folder: str, out: str, progress: str, schema: str, make, fmt: str = "parquet") -> int:
    """Apply ``make`` to files that no earlier call has seen and add the rows to ``out``; how many rows were added.

    ``progress`` is the folder that remembers the files; a call that is cut off is
    taken up by the next one, each file once.
    """
    done = file_stream(spark, folder, schema, fmt)
    query = make(done).writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).outputMode("append").start(out)
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def latest(updates: DataFrame, key: str = "name") -> DataFrame:
    """The last update of each key from (key, state, batch)."""
    return updates.groupBy(key).agg(F.max_by("state", "batch").alias("state"))
