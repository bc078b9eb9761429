"""Exchanges of live sessions: what a stream says last equals what a batch says over all rows."""

import random
from datetime import datetime, timedelta


from terrane.operators import groups
from terrane.streaming import sessions

SCHEMA = "s string, turn int, ts timestamp, role string, text string"
START = datetime(2024, 1, 1)


def rows(seed=1, n=12):
    rnd = random.Random(seed)
    out = []
    for s in range(n):
        for k in range(rnd.randint(1, 14)):
            out.append((f"s{s}", k, START + timedelta(seconds=30 * k + s), rnd.choice(["user", "assistant"] if rnd.random() < 0.3 else [["user", "assistant"][k % 2]]), f"{s}/{k}"))
    return out


def streamed(spark, tmp_path, parts, idle=10_000_000):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        import os
        import time

        os.utime(next((tmp_path / "in" / str(k)).glob("*.parquet")), (time.time() - 100 + k, time.time() - 100 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    last = {}

    def keep(batch, number):
        for r in batch.collect():
            last[r.session] = (r.ended, [tuple(x) for x in r.exchanges])

    live = sessions.live_exchanges(stream, "s", "turn", "ts", 2, idle, "10 minutes")
    live.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/offsets").trigger(availableNow=True).start().awaitTermination()
    return last


def test_stream_equals_batch_with_late_and_repeated_rows(spark, tmp_path):
    data = rows()
    rnd = random.Random(2)
    late = data[:]
    rnd.shuffle(late)
    odd = [(None, 1, START, "user", "x"), ("s1", None, START, "user", "x"), ("s1", 3, None, "user", "x")]
    last = streamed(spark, tmp_path, [late[:40] + odd, late[30:70], late[60:]])
    batch = groups.last_exchanges(spark.createDataFrame(data, SCHEMA).select("s", "turn", "role", "text"), "s", "turn", 2)
    want = {}
    for r in batch.orderBy("s", "n_back").collect():
        want.setdefault(r.s, []).append((r.turn, r.text, r.reply))
    assert {s: x for s, (ended, x) in last.items() if x} == want and set(last) == {r[0] for r in data}


def test_idle_sessions_end_and_too_late_rows_are_left_out(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    first = [("a", 0, at(0), "user", "q"), ("a", 1, at(1), "assistant", "r"), ("b", 0, at(50), "user", "q")]
    second = [("b", 1, at(90), "assistant", "r"), ("a", 2, at(2), "user", "much too late")]
    last = streamed(spark, tmp_path, [first, second, [("c", 0, at(200), "user", "q")], [("c", 1, at(201), "assistant", "r")]], idle=3600)
    assert last["a"] == (True, []) and last["b"][0] and last["c"] == (False, [(0, "q", "r")])


def test_state_is_a_suffix():
    turns = [[k, float(k), "user" if k % 2 == 0 else "assistant", "x"] for k in range(20)]
    assert sessions.kept_from(turns, 2, 100.0) == 16
    assert sessions.kept_from(turns, 2, 5.0) == 4
    assert sessions.kept_from(turns[:1], 2, 0.0) == 0
