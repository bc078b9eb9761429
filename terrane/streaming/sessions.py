"""The last exchanges of sessions that are going on, as keyed state that expires.

An exchange is a user's turn and the assistant's turn next to it by order. The state of a session is the run of turns from
the oldest of its last exchanges, or from the last turn before the watermark if that is older: a row that comes late, but
within the watermark, finds its neighbours there, and what is older cannot change any more. A turn that comes again
replaces itself. A session that was idle for its time to live ends: its state goes and a last row says so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIRS = "array<struct<turn:long,text:string,reply:string>>"


def exchanges(turns: list[list]) -> list[int]:
    """Where exchanges begin in turns [order, time, role, text], sorted."""
    return [k for k in range(len(turns) - 1) if turns[k][2] == "user" and turns[k + 1][2] == "assistant"]


def kept_from(turns: list[list], most: int, watermark: float) -> int:
    """The first turn that later rows, or the last exchanges, may need."""
    begins = exchanges(turns)[-most:]
    settled = [k for k, t in enumerate(turns) if t[1] < watermark]
    return min([begins[0] if begins else len(turns), settled[-1] if settled else 0])


def live_exchanges(turns: DataFrame, session: str, order: str, ts: str, most: int, idle_seconds: int, late: str = "10 minutes") -> DataFrame:
    """session, exchanges (the last ones, latest first) and ended, for each session that rows came for or that ended.

    turns: session, order, ts, role, text. Each row for a session replaces the one before. Rows without a session, an order
    or a time are left out; so are rows older than the watermark.
    """

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "found": ["[]"], "ended": [True]})
            return
        held = {t[0]: t for t in (json.loads(state.get[0]) if state.exists else [])}
        for part in rows:
            for o, at, role, text in zip(part["turn"], part["at"], part["role"], part["text"], strict=True):
                new = [int(o), float(at), role, text]
                held[int(o)] = max(held.get(int(o), new), new, key=lambda t: (t[1], str(t[2]), str(t[3])))
        turns_ = [held[o] for o in sorted(held)]
        watermark = state.getCurrentWatermarkMs() / 1000
        found = [{"turn": turns_[k][0], "text": turns_[k][3], "reply": turns_[k + 1][3]} for k in exchanges(turns_)[-most:]]
        state.update((json.dumps(turns_[kept_from(turns_, most, watermark) :]),))
        state.setTimeoutTimestamp(int(max(max(t[1] for t in turns_) + idle_seconds, watermark + 0.001) * 1000) + 1)
        yield pd.DataFrame({"session": [key[0]], "found": [json.dumps(found[::-1])], "ended": [False]})

    known = turns.where(F.col(session).isNotNull() & F.col(order).isNotNull() & F.col(ts).isNotNull())
    timed = known.select(F.col(session).cast("string").alias("session"), F.col(order).cast("long").alias("turn"), F.col(ts).cast("timestamp").alias("ts"), F.col(ts).cast("timestamp").cast("double").alias("at"), "role", "text")
    out = timed.withWatermark("ts", late).groupBy("session").applyInPandasWithState(update, "session string, found string, ended boolean", "turns string", "update", GroupStateTimeout.EventTimeTimeout)
    return out.select("session", F.from_json("found", PAIRS).alias("exchanges"), "ended")
