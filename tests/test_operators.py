"""Joins, statistics, groups, state, files and streams on inline rows."""

import pytest
from pyspark.sql import functions as F

from terrane.operators import changes, groups, joins, stats
from terrane.operators.components import components
from terrane.sources import files
from terrane.sources.storage import table
from terrane.streaming import events as ev


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_lookup_keeps_rows_without_a_match(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "f int, v string")
    out = joins.lookup_array(a, b, ("k", "f"), "hits")
    assert rows(out.select("k", F.size("hits")), "k") == [(None, 1), (1, 2), (2, 0)]


def test_first_match_takes_the_first_candidate_that_exists(spark):
    left = spark.createDataFrame([(1, "kyiv", "r1"), (2, "oslo", "r1"), (3, "oslo", "r9")], "i int, city string, region string")
    right = spark.createDataFrame([("c:kyiv", 10.0), ("r:r1", 20.0)], "k string, q double")
    out = joins.first_match(left, right, [F.concat(F.lit("c:"), "city"), F.concat(F.lit("r:"), "region")], "k", ["i"])
    assert rows(out.select("i", "match_rank", "q"), "i") == [(1, 0, 10.0), (2, 1, 20.0), (3, None, None)]


def test_repeats_and_difference(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "i int, h string")
    assert rows(joins.repeats(df, F.col("h"), "i", "i"), "i") == [(1, 0, None), (2, 0, None), (3, 1, 1), (4, 2, 1)]
    a, b = spark.createDataFrame([("x", 5.0), ("y", 1.0)], "k string, v double"), spark.createDataFrame([("x", 2.0), ("z", 9.0)], "k string, v double")
    assert rows(joins.full_outer_difference(a, b, "k", "v"), "k") == [("x", 5.0, 2.0, 3.0), ("y", 1.0, None, None), ("z", None, 9.0, None)]


def test_quartiles_interpolate_and_skip_what_is_not_positive(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, -5.0, 0.0, None)], "x double")
    assert rows(stats.quartiles(df, [], F.col("x"))) == [(4, 1.75, 2.5, 3.25, 4.0)]
    assert rows(stats.quartiles(df.limit(0), [], F.col("x"))) == []
    one = stats.value_counts(df.where("x = 1"), [], F.col("x"))
    assert rows(stats.with_moments(one, [], stats.quartiles_of(one, [])))[0] == (1, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0)


def test_quartiles_of_many_groups_and_repeated_values(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    data = {g: np.round(np.exp(rng.normal(3, width, n)), 1) for g, width, n in (("a", 2.0, 400), ("b", 0.01, 333), (None, 1e-9, 50), ("c", 1.0, 1))}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs], "g string, x double")
    got = {r.g: tuple(r)[1:] for r in stats.quartiles(df, ["g"], F.col("x")).collect()}
    assert set(got) == set(data)
    for g, xs in data.items():
        assert got[g][0] == (xs > 0).sum() and np.allclose(got[g][1:], [*np.quantile(xs[xs > 0], [0.25, 0.5, 0.75]), xs.max()])


def test_indicator_thresholds(spark):
    data = [("land", "r", f"p{n}", 100.0 + i) for n in (2, 3, 4, 5) for i in range(n)]
    out = stats.indicators(spark.createDataFrame(data, "kind string, region string, place string, v double"), "v", "kind", "region", "place")
    assert rows(out.select("place", "count"), "place") == [(None, 14), ("p5", 5)]


def test_rollup_counts_a_period_over_all_its_rows(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 3.0), ("2024-02-01", 5.0)], "d string, v double").withColumn("d", F.to_date("d"))
    out = stats.period_rollup(df, {"day": F.date_format("d", "yyyy-MM-dd"), "month": F.date_format("d", "yyyy-MM")}, [], ["v"])
    assert rows(out.select("period_type", "period_key", "avg", "count"), "period_type", "period_key")[-2:] == [("month", "2024-01", 2.0, 2), ("month", "2024-02", 5.0, 1)]


def test_anomalies_global_before_local(spark):
    data = [("a", float(x)) for x in range(100, 120)] + [("b", float(x)) for x in range(1000, 1020)] + [("a", 5000.0), ("a", 800.0), ("a", None)]
    out = stats.anomalies(spark.createDataFrame(data, "g string, v double"), "v", ["g"])
    assert rows(out.select("v", "scope"), "v") == [(800.0, "local"), (5000.0, "global")]


def test_tiers(spark):
    tiers = [(0, 100, 1.0), (100, None, 0.5)]
    df = spark.createDataFrame([(0,), (100,), (150,)], "n int").select("n", stats.tiered_cost(F.col("n"), tiers))
    assert rows(df, "n") == [(0, 0.0), (100, 100.0), (150, 125.0)]


def test_counts_of_nothing_are_no_row(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert rows(groups.count_rows(df)) == [(1,)]
    assert rows(groups.count_rows(df.limit(0))) == []


def test_majority_tie_goes_to_the_first_met(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "c", 0)], "k int, v string, pos int")
    assert rows(groups.majority(df, ["k"], "v", F.col("pos")), "k") == [(1, "b", 2), (2, "c", 1)]


def test_exchanges_buckets_and_distinct(spark):
    t = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(["system", "user", "assistant", "user", "user", "assistant"])], "s int, n int, role string, text string")
    assert rows(groups.last_exchanges(t, "s", "n", 1)) == [(1, 4, "t4", "t5", 1)]
    v = spark.createDataFrame([(["a", "b", ""],), (["b", None],), (None,)], "x array<string>")
    assert rows(groups.distinct_values(v, F.col("x"), True)) == [("a",), ("b",)]
    b = spark.createDataFrame([(-1,), (0,), (10,), (99,)], "x int").select(groups.buckets(F.col("x"), [0, 10, 50]))
    assert rows(b) == [("other",), ("0",), ("10",), ("other",)]


def test_by_metric_and_tagged_union(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), (None, 9.0), ("b", None), ("b", -1.0)], "g string, m double")
    out = groups.by_metric(df, F.col("m"), "avg", [F.coalesce("g", F.lit("")).alias("g")], True, 10)
    assert rows(out) == [("", 9.0, 1), ("a", 3.0, 2)]
    both = groups.union_tagged({"x": df.select("g"), "y": df.select("m")})
    assert both.columns == ["g", "source", "m"] and both.count() == 10


def test_state_changes(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "k int, v string, created int")
    new = spark.createDataFrame([(2, "B", 20), (3, "c", 20)], "k int, v string, created int")
    assert rows(changes.compare(old, new, ["k"], ["v"]), "k") == [(1, "gone"), (2, "changed"), (3, "new")]
    assert rows(changes.upsert(old, new, ["k"], ["created"]), "k") == [(1, "a", 10), (2, "B", 10), (3, "c", 20)]
    assert rows(changes.replace_rows(old, new, ["k"]), "k") == [(1, "a", 10), (2, "B", 20), (3, "c", 20)]
    assert rows(changes.insert_absent(old, new, ["k"]), "k") == [(1, "a", 10), (2, "b", 10), (3, "c", 20)]
    assert rows(changes.update_where(old, F.col("v") == "a", {"v": F.lit("z")}), "k") == [(1, "z", 10), (2, "b", 10)]
    assert rows(changes.delete_where(old, F.lit(None) == F.col("k")), "k") == rows(old, "k")
    sets = spark.createDataFrame([(1, ["x"]), (2, None)], "k int, s array<string>")
    more = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, s string")
    assert rows(changes.add_to_sets(sets, more, ["k"], "s"), "k") == [(1, ["x", "y"]), (2, ["z"])]
    assert changes.dimension(old, ["v"]).count() == 2


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (10, 11), (11, 10), *[(100 + i, 101 + i) for i in range(40)]], "u long, v long")
    got = dict(rows(components(edges)))
    assert got[3] == 1 and got[11] == 10 and {got[k] for k in range(100, 141)} == {100}
    assert rows(components(edges.limit(0))) == []


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "ж;\"x\"", ["a"]), (2, None, None)], "i int, s string, l array<string>")
    files.write_csv(df, f"file://{tmp_path}/csv")
    raw = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfi;s;l")
    back = files.read_csv(spark, f"file://{tmp_path}/csv")
    assert sorted(rows(back.select("i", "s"))) == [("1", "ж;\"x\""), ("2", None)]
    files.write_json(df, f"file://{tmp_path}/json", ["i", "s"])
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2


def test_ranges_tiles_and_pages(spark):
    assert spark.range(1).select(files.months("2024-11-15", "2025-02-15")).count() == 4
    cells = files.tile_cells(spark, 30.0, 50.0, 31.0, 51.0, 10)
    assert all(r.west < r.east and r.south < r.north for r in cells.collect())
    html = "<html lang=\"uk\"><head><title> A </title><script>x<y</script></head><body><a href=1>b</a> c</body></html>"
    f = files.page_fields(F.lit(html))
    assert rows(spark.range(1).select(f["title"], f["lang"], f["n_links"], f["text"])) == [("A", "uk", 1, "A b c")]
    ids = spark.createDataFrame([(1,), (1,), (9,)], "x int")
    assert files.rows_by_ids(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k", ids).count() == 1


def test_unknown_tables_are_refused(spark):
    with pytest.raises(ValueError, match="no such table"):
        table(spark, "/nowhere", "secrets")


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    data = spark.createDataFrame([(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 2, float(i)) for i in range(30)], "ts string, u int, v double").withColumn("ts", F.to_timestamp("ts"))
    src = f"file://{tmp_path}/in"
    data.repartition(3).write.parquet(src)
    made = {"n": F.count("*"), "total": F.sum("v")}
    want = rows(ev.windows(data, "ts", "1 day", None, ["u"], made), "start", "u")
    got = ev.windows(ev.read_stream(spark, src), "ts", "1 day", None, ["u"], made)
    q = got.writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination()
    assert rows(spark.table("tumbling"), "start", "u") == want


def test_a_stream_keeps_the_first_of_each_key_and_updates_state(spark, tmp_path):
    src, seen = f"file://{tmp_path}/in", []
    spark.createDataFrame([("2024-01-01 00:00:00", k) for k in (1, 1, 2, 3, 3)], "ts string, k int").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    ev.run_available(ev.first_of_key(ev.read_stream(spark, src), ["k"], "ts"), lambda df, n: seen.extend(r.k for r in df.collect()), f"file://{tmp_path}/c")
    assert sorted(seen) == [1, 2, 3]


def test_broken_rules_are_counted(spark):
    df = spark.createDataFrame([(1, "a"), (-1, None), (None, "b")], "n int, s string")
    out = groups.broken_rules(df, {"n positive": F.col("n") > 0, "s present": F.col("s").isNotNull()})
    assert rows(out, "rule") == [("n positive", 2), ("s present", 1)]


def test_schema_profile_goes_into_nested_fields(spark):
    from terrane.operators import profiles

    df = spark.createDataFrame([(1, [("a", None), ("b", 2)]), (None, None), (3, [])], "k int, items array<struct<n:string,v:int>>")
    got = {r.path: (r.type, r.nullable, r.n_values, round(r.rate, 4), r.examples) for r in profiles.schema_profile(df).collect()}
    assert got["k"] == ("int", True, 2, 0.6667, ["1", "3"])
    assert got["items"] == ("array", True, 2, 0.6667, [])
    assert got["items[].n"] == ("string", False, 2, 0.3333, ["a", "b"]) or got["items[].n"][:3] == ("string", False, 2)
    assert got["items[].v"][:3] == ("int", True, 1)


def test_linked_objects_join_through_either_key(spark):
    from terrane.operators import entities

    df = spark.createDataFrame([(1, "x", None), (2, "x", "p"), (3, None, "p"), (4, None, None), (5, "y", ""), (6, "", None)], "id long, a string, b string")
    got = rows(entities.linked_objects(df, [F.col("a"), F.col("b")], F.col("id"), ["a"]), "first_ref")
    assert got == [(1, 3, "x"), (4, 1, None), (5, 1, "y"), (6, 1, "")]


def test_snowflake_ids_are_the_same_on_every_load(spark):
    from terrane.operators import entities

    df = spark.createDataFrame([("r", "c"), ("r", "d"), ("s", "c"), (None, "c"), ("r", None)], "region string, city string")
    first, tables = entities.resolve_snowflake({}, df.limit(2), ["region", "city"])
    again, more = entities.resolve_snowflake(tables, df, ["region", "city"])
    assert more["region"].count() == 2 and more["city"].count() == 3
    assert again.where("region is null and city_id is not null").count() == 0
    assert first.join(again, ["region", "city", "region_id", "city_id"]).count() == 2


def test_repeats_and_missing_dates(spark):
    from terrane.operators import entities

    df = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "a", "2024-01-02"), (3, "a", "2024-01-02"), (4, "a", None), (5, "b", None), (6, "c", "2024-01-01")], "id int, h string, t string")
    got = rows(entities.earlier_repeats(df, F.col("h"), "id", "t"), "id")
    assert got == [(1, True, 1), (2, True, 2), (3, True, 2), (4, True, 3), (5, False, 0), (6, False, 0)]


def test_rollup_is_one_shuffle_of_rows_and_large_groups_go_by_slices(spark, monkeypatch):
    df = spark.createDataFrame([(1 + i % 3 // 2, float(i % 40), 2.0 * i if i % 5 else None) for i in range(300)], "kind int, a double, b double")
    rollup = lambda: stats.period_rollup(df, {"all": F.lit("x")}, ["kind"], ["a", "b"])
    short = lambda out: sorted((r.metric, r.kind, r["count"], *[round(r[c], 6) for c in ("avg", "std", "q1", "q2", "q3", "q4")]) for r in out.collect())
    one = rollup()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # rows went through eight before
    monkeypatch.setattr(stats, "IN_LIST", 250)
    assert short(rollup()) == short(one)
    quartiles = lambda: sorted(tuple(round(x, 6) for x in r) for r in stats.quartiles(df, ["kind"], F.col("a")).collect())
    sliced = quartiles()
    monkeypatch.setattr(stats, "IN_LIST", 10**6)
    assert quartiles() == sliced


def test_quartiles_of_small_groups_take_one_shuffle(spark):
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(100)], "kind int, a double")
    plan = stats.quartiles(df, ["kind"], F.col("a"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_slices_move_only_the_values_of_opened_slices(spark):
    """100,000 different values: what is sent between tasks is sums of slices and a few values, not every value."""
    df = spark.range(100_000).select(F.lit("a").alias("kind"), (1000 + F.col("id") / 100).alias("a"))
    counts = stats.positive(df, ["kind"], F.col("a"))
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    got = stats.quartiles_of(counts, ["kind"]).first()
    assert tuple(got) == ("a", 100_000, 1249.9975, 1499.995, 1749.9925, 1999.99)
    twice = stats.quartiles_of(counts.unionByName(counts.withColumn("n", F.lit(2).cast("long"))), ["kind"]).first()
    assert twice["n"] == 300_000 and abs(twice["q2"] - 1499.995) < 1e-9


def test_rollup_of_several_periods_gathers_rows_once(spark, monkeypatch):
    """Rows are not repeated for each period before they are gathered; large days and large years go by slices."""
    data = [(i % 2, f"d{i % 7 if i % 4 else 0}", float(i), i % 3 * 1.5 if i % 5 else None) for i in range(1, 400)]
    df = spark.createDataFrame(data, "kind int, day string, a double, b double")
    rollup = lambda: stats.period_rollup(df, {"day": F.col("day"), "year": F.lit("y"), "none": F.lit(None).cast("string")}, ["kind"], ["a", "b"])
    short = lambda out: sorted((r.metric, r.period_type, str(r.period_key), r.kind, r["count"], *[round(r[c], 6) for c in ("avg", "std", "q1", "q2", "q3", "q4")]) for r in out.collect())
    one = rollup()
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("collect_list") > plan.index("explode") and plan.count("Aggregate") == 2
    want = short(one)
    assert sum(x[4] for x in want if x[0] == "a" and x[1] == "year") == 399
    for most in (40, 120, 250, 500):
        monkeypatch.setattr(stats, "IN_LIST", most)
        assert short(rollup()) == want
