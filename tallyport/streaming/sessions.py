"""Session status as a stream: keyed state that never leaves a terminal status, and duplicates that are dropped in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATUS = {"upload:paused": "paused", "resume:started": "resuming", "completed": "completed", "upload:canceled": "canceled", "failed": "failed"}
TERMINAL = {"completed", "canceled"}
#: Events that say nothing about the status.
SILENT = ("resume:cleanup-failed", "validated", "resume:conflict")
OUTPUT = "session_id long, status string, events long"
STATE = "status string, last long, events long, latest long"


#: How long a session may be silent before its state goes, in milliseconds.
IDLE_MS = 30 * 86_400_000


def session_status(events: DataFrame, late: str = "10 minutes", idle_ms: int = IDLE_MS) -> DataFrame:
    """Status of each session after each batch of ``events (session_id, event_id, event_time, type)``.

    Events that come twice within ``late`` count once; an older event never takes back what a newer one
    said, but a terminal one counts however late it comes.  A session whose last event is ``idle_ms`` behind the watermark is
    forgotten, so that state is bounded by the sessions of that time; an event after that begins it anew.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, last, seen, latest = state.get if state.exists else ("idle", -1, 0, 0)
        for batch in batches:
            seen += len(batch)
            latest = max(latest, int(batch["event_time"].max().value // 1_000_000))
            if status in TERMINAL:
                continue
            now = batch["type"].map(STATUS).fillna("uploading")
            ended = now.isin(TERMINAL)
            newest = (batch["event_id"].where(ended).idxmin() if ended.any() else batch["event_id"].idxmax())
            if ended.any() or batch["event_id"][newest] > last:
                status = now[newest]
            last = max(last, int(batch["event_id"].max()))
        state.update((status, int(last), int(seen), latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"session_id": [key[0]], "status": [status], "events": [seen]})

    clean = events.filter(~F.col("type").isin(*SILENT)).withColumn("event_time", F.col("event_time").cast("timestamp"))
    once = clean.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["session_id", "event_id"])
    return once.groupBy("session_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
