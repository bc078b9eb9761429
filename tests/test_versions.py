"""Versions of tables, feeds that are killed and run again, and roll-ups kept up by loads."""

import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import rollups, stats
from terrane.sources.versions import Versions
from terrane.streaming import events
from terrane.streaming.phases import Feed


def keys(df):
    return sorted(r.id for r in df.collect())


def test_reader_sees_one_version_whole(spark, tmp_path):
    t = Versions(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.entry()["batch"] == -1
    t.publish(spark.range(3))
    reader = t.read()
    t.publish(spark.range(10, 15))
    assert keys(reader) == [0, 1, 2] and keys(t.read()) == [10, 11, 12, 13, 14] and keys(t.read(0)) == [0, 1, 2]
    t.clear(2)
    assert keys(reader) == [0, 1, 2]
    t.clear(1)
    assert keys(t.read()) == [10, 11, 12, 13, 14] and len(t.numbers()) == 1


def test_rebuild_that_fails_leaves_the_old_version_and_its_remains_go(spark, tmp_path):
    t = Versions(spark, f"file://{tmp_path}/t")
    t.publish(spark.range(3))
    with pytest.raises(Exception, match="broken"):
        t.publish(spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id")))
    assert keys(t.read()) == [0, 1, 2]
    t._written(spark.range(4), 7)  # a writer that was killed before its entry
    assert len([g for g in t.clear() if g.startswith("data/")]) >= 1 and keys(t.read()) == [0, 1, 2]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    a, b = (Versions(spark, f"file://{tmp_path}/t") for _ in range(2))
    a.publish(spark.range(1))
    monkeypatch.setattr(b, "numbers", lambda: [])  # b read the log before a wrote
    with pytest.raises(Exception, match="xist"):
        b.publish(spark.range(2))
    assert keys(a.read()) == [0]


def test_batch_counts_once(spark, tmp_path):
    t = Versions(spark, f"file://{tmp_path}/t")
    assert t.append(spark.range(2), 0) and not t.append(spark.range(2), 0) and t.append(spark.range(2, 4), 1)
    assert keys(t.read()) == [0, 1, 2, 3] and keys(t.read(before=1)) == [0, 1] and keys(t.read(only=1)) == [2, 3]
    t.compact(lambda df: df.where("id > 0"))
    assert keys(t.read()) == [1, 2, 3] and not t.append(spark.range(9), 1)


SCHEMA = "id long, place string, price double, seen long"


def feed_of(spark, path):
    return Feed(spark, path, "id", "seen", ["place", "price"], {"place": F.col("place")}, F.col("price"))


def batches(seed=3):
    rnd = random.Random(seed)
    row = lambda n: (rnd.randint(0, 60), rnd.choice(["a", "b", None]), rnd.choice([None, 0.0, *map(float, range(1, 9))]), n)
    return [[row(n * 100 + k) for k in range(40)] + [(None, "a", 5.0, n)] for n in range(3)]


def expected(data):
    last = {}
    for rows in data:
        for i, place, price, seen in rows:
            if i is not None:
                last[i] = (place, price, seen)
    groups = {}
    for place, price, _ in last.values():
        if price and price > 0:
            groups.setdefault(place, []).append(price)
    return {i: v[:2] for i, v in last.items()}, {g: (len(v), round(sum(v) / len(v), 6), max(v)) for g, v in groups.items()}


def state(feed):
    return {r.id: (r.place, r.price) for r in feed.current().collect()}, {r.place: (r["count"], round(r.avg, 6), r.q4) for r in feed.rollup.current().collect()}


def test_feed_equals_the_last_rows(spark, tmp_path):
    feed, data = feed_of(spark, f"file://{tmp_path}/feed"), batches()
    for n, rows in enumerate(data):
        for _ in range(2 if n == 1 else 1):
            feed.apply(spark.createDataFrame(rows, SCHEMA), n)
        assert state(feed) == expected(data[: n + 1])
    feed.rollup.compact()
    feed.apply(spark.createDataFrame([(1, "a", 3.0, 900)], SCHEMA), 3)
    assert state(feed) == expected([*data, [(1, "a", 3.0, 900)]])


@pytest.mark.parametrize("kill", ["main", "counts"])
def test_stream_that_is_killed_and_started_again(spark, tmp_path, kill, monkeypatch):
    data, source = batches(5)[:2], f"{tmp_path}/source"
    feed = feed_of(spark, f"file://{tmp_path}/feed")
    offsets, tables = f"file://{tmp_path}/offsets", {"main": feed.main, "counts": feed.rollup.counts, "figures": feed.rollup.figures}
    spark.createDataFrame(data[0], SCHEMA).coalesce(1).write.parquet(f"file://{source}/part=0")
    events.run_available(events.read_stream(spark, f"file://{source}"), feed.apply, offsets)
    spark.createDataFrame(data[1], SCHEMA).coalesce(1).write.parquet(f"file://{source}/part=1")
    whole = tables[kill]._commit

    def killed(entry):
        raise RuntimeError("killed before the entry")

    monkeypatch.setattr(tables[kill], "_commit", killed)
    with pytest.raises(Exception, match="killed"):
        events.run_available(events.read_stream(spark, f"file://{source}"), feed.apply, offsets)
    monkeypatch.setattr(tables[kill], "_commit", whole)
    events.run_available(events.read_stream(spark, f"file://{source}"), feed.apply, offsets)
    assert state(feed) == expected(data)


def test_rollup_equals_full_recomputation_and_reads_only_its_load(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice(["x", "y", None]), f"2024-0{1 + k // 100}", float(rnd.randint(1, 50))) for k in range(300)]
    r = rollups.Rollup(spark, f"file://{tmp_path}/r", ["place", "month"])
    for n in range(3):
        part = spark.createDataFrame(rows[n * 90 : n * 90 + 120], "place string, month string, v double").withColumn("n", F.lit(1))
        r.load(part, n)
        assert {x.month for x in r.figures.read(only=n).collect()} == {x[1] for x in rows[n * 90 : n * 90 + 120]}
    seen = [x for n in range(3) for x in rows[n * 90 : n * 90 + 120]]
    whole = stats.value_counts(spark.createDataFrame(seen, "place string, month string, price double"), ["place", "month"], F.col("price"))
    want = sorted(map(tuple, rollups.figures(whole, ["place", "month"]).collect()), key=str)
    assert sorted(map(tuple, r.current().select(*["place", "month", "avg", "std", "count", "q1", "q2", "q3", "q4"]).collect()), key=str) == want
