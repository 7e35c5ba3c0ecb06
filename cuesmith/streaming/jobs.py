"""Job events as streams: repeated requests, states with illegal moves, sessions and cooldowns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Which event types may follow which; a job begins with a view or a signup.
FOLLOWS = {
    "": {"view", "signup"}, "error": {"view", "signup"}, "view": {"view", "signup", "purchase", "error", "click"},
    "click": {"view", "signup", "purchase", "error", "click"}, "signup": {"view", "signup", "error", "click"}, "purchase": {"view", "signup", "error", "click"},
}


def timed(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def first_requests(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Each request once by its key; what repeats later than the watermark's delay counts as new."""
    return timed(events, delay).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """``user_id, start, end, n`` of stretches without a pause of ``gap``."""
    per = timed(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def states(events: DataFrame) -> DataFrame:
    """``user_id, event_id, event_type, previous, legal`` of every event, in order of time within a trigger and key.

    Illegal moves are marked, not rejected, and the state follows the event. The state of a key is one event type.
    """

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else ("",)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, kind in zip(rows["event_id"], rows["event_type"]):
            out.append((key[0], event, kind, last or None, kind in FOLLOWS.get(last, set())))
            last = kind
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type", "previous", "legal"])

    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .groupBy("user_id")
        .applyInPandasWithState(walk, "user_id long, event_id long, event_type string, previous string, legal boolean", "last string", "append", GroupStateTimeout.NoTimeout)
    )


def cooling(events: DataFrame, seconds: int = 60) -> DataFrame:
    """For each minute and user with an error until when the user is left alone."""
    errors = timed(events).where("event_type = 'error'")
    per = errors.groupBy(F.window("ts", "1 minute").alias("w"), "user_id").agg(F.max("ts").alias("last"))
    return per.select("user_id", F.col("w.start").alias("minute"), (F.col("last") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("until"))


def replay(frame: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and give the result as a table in memory, for tests and reports."""
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
