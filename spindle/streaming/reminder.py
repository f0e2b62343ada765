"""A reminder at every twentieth turn of a session, as a stateful stream.

The state of a session is one counter, kept by the state store; every turn is one event. Counters from before the
stream can be taken over as its first state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..sources.shared import ship

#: Fixed values.
INTERVAL = 20
REMINDER = "This session is long: consider writing down where the analysis stands."


class TurnCounter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getValueState("turns", StructType([StructField("n", LongType())]))

    def handleInitialState(self, key, state: pd.DataFrame, timer_values) -> None:
        self.turns.update((int(state["n"].max()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        before = self.turns.get()[0] if self.turns.exists() else 0
        for batch in rows:  # only their lengths are looked at
            now = before + len(batch)
            due = range((before // INTERVAL + 1) * INTERVAL, now + 1, INTERVAL)
            if due:
                yield pd.DataFrame({"session_id": key[0], "turn": list(due), "reminder": REMINDER})
            before = now
        self.turns.update((before,))

    def close(self) -> None:
        pass


def taken_over(counters: DataFrame) -> DataFrame:
    """session_id, n from stored counters (session_id, value): keys as the stream makes them, what is no number as
    0, the largest of a key that is there more than once. Counters without a key are left out."""
    rows = counters.select(T.state_key(F.col("session_id")).alias("session_id"), F.coalesce(T.counter_value(F.col("value")), F.lit(0)).cast("long").alias("n"))
    return rows.where("session_id <> ''").groupBy("session_id").agg(F.max("n").alias("n"))


def reminders(events: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """session_id, turn, reminder from a stream of (session_id). Ids are cut to harmless characters;
    events without an id do nothing. counters (session_id, value) are where sessions stand when the stream is
    started for the first time; later starts go on from its own state."""
    ship(events.sparkSession)
    keyed = events.select(T.state_key(F.col("session_id")).alias("session_id")).where("session_id <> ''")
    first = None if counters is None else taken_over(counters).groupBy("session_id")
    return keyed.groupBy("session_id").transformWithStateInPandas(TurnCounter(), "session_id string, turn long, reminder string", "append", "None", first)


def run_available(spark: SparkSession, events: DataFrame, checkpoint: str, output: str, counters: DataFrame | None = None) -> DataFrame:
    """Process what a stream holds now, append the reminders to the Parquet folder ``output``, and
    return all that it holds. A later call with the same checkpoint goes on from the kept counters. While the
    stream runs, the session's state store is RocksDB, which such a state needs."""
    store = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    due = reminders(events, counters)
    try:
        stream = due.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.set(store, held) if held else spark.conf.unset(store)
    return spark.read.schema(due.schema).parquet(output)
