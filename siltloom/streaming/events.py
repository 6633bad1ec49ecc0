"""Push events: triggers, duplicate deliveries, coalescing, refresh of the touched slices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltloom.plans.index import index_repos, store
from siltloom.sources.files import parsed


def reindex_triggers(events: DataFrame) -> DataFrame:
    """Deliveries (delivery, event, ts, payload) that call for an index run: (delivery, ts, repo, branch, reason).

    Pushes to a branch, and closed pull requests that were merged; all others are left out. Works on batches and streams.
    """
    p = parsed(events)
    push = (F.col("event") == "push") & F.col("p.ref").startswith("refs/heads/") & (F.col("p.repository.full_name") != "")
    merge = (F.col("event") == "pull_request") & (F.col("p.action") == "closed") & F.col("p.pull_request.merged") & (F.col("p.repository.full_name") != "") & (F.col("p.pull_request.base.ref") != "")
    branch = F.when(push, F.regexp_replace("p.ref", "^refs/heads/", "")).otherwise(F.col("p.pull_request.base.ref"))
    return p.where(push | merge).select("delivery", "ts", F.col("p.repository.full_name").alias("repo"), branch.alias("branch"), F.when(push, "push").otherwise("merge").alias("reason"))


def dedup_deliveries(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each delivery once; a stream remembers them for the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["delivery"])
    first = F.min(F.struct("ts", *[c for c in events.columns if c not in ("ts", "delivery")]))
    return events.groupBy("delivery").agg(first.alias("r")).select("delivery", "r.*").select(*events.columns)


def trigger_windows(triggers: DataFrame, window: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """One run for all triggers of a slice in a tumbling window: (window_start, repo, branch, n_triggers)."""
    t = triggers.withWatermark("ts", watermark) if triggers.isStreaming else triggers
    return t.groupBy(F.window("ts", window).alias("w"), "repo", "branch").agg(F.count("*").alias("n_triggers")).select(F.col("w.start").alias("window_start"), "repo", "branch", "n_triggers")


def quiet_runs(triggers: DataFrame, quiet: str = "10 minutes", watermark: str | None = "1 hour") -> DataFrame:
    """One run for all triggers of a slice that follow each other within ``quiet``, once none has come for that long: (repo, branch, first_ts, last_ts, n_triggers).

    A session window keeps the state and closes it in event time; a stream gives a run when the watermark has passed its end. Pass no ``watermark`` for a stream that has one.
    """
    t = triggers.withWatermark("ts", watermark) if triggers.isStreaming and watermark else triggers
    runs = t.groupBy(F.session_window("ts", quiet).alias("w"), "repo", "branch").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_triggers"))
    return runs.select("repo", "branch", "first_ts", "last_ts", "n_triggers")


def refresh(
    events: DataFrame, files: Callable[[], DataFrame], root: str, fn: Callable[[list[str]], np.ndarray], dim: int, checkpoint: str, quiet: str | None = None, save: Callable[[dict, str, DataFrame], object] = store
) -> StreamingQuery:
    """Run through the events that are there: in each batch the touched slices are indexed anew and replaced.

    With ``quiet`` a slice is indexed once for all triggers that follow each other within that time, when it is over. ``save`` stores the tables; ``publish`` makes them a version of a snapshot store.
    A batch that is repeated after a failure replaces the same slices with the same rows.
    """

    def batch(df: DataFrame, _: int) -> None:
        slices = df.select("repo", "branch").distinct().persist()
        try:
            if not slices.isEmpty():
                save(index_repos(files().join(slices, ["repo", "branch"], "left_semi"), fn, dim), root, slices)
        finally:
            slices.unpersist()

    triggers = reindex_triggers(dedup_deliveries(events))
    runs = quiet_runs(triggers, quiet, None) if quiet else triggers
    return runs.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
