"""Keys that are null or repeat, and names of places in running text."""

from pyspark.sql import functions as F

from terrane.functions import columns as C
from terrane.functions import places as P
from terrane.functions import texts as X
from terrane.operators import changes, entities, joins


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_rows_without_a_key_repeat_nothing(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, "a", 1), (4, "a", 2), (5, "a", None)], "id int, k string, t int")
    assert rows(entities.earlier_repeats(df, F.col("k"), "id", "t"), "id") == [(1, False, 0), (2, False, 0), (3, True, 1), (4, True, 2), (5, True, 2)]
    assert rows(joins.repeats(df, F.col("k"), "id", "t"), "id") == [(1, 0, None), (2, 0, None), (3, 1, 5), (4, 2, 5), (5, 0, None)]


def test_nearest_earlier_rows_are_listed(spark):
    data = [(i, "a" if i % 4 else None, i // 3) for i in range(40)] + [(90, "a", None), (91, "b", 3)]
    df = spark.createDataFrame(data, "id int, k string, t int")
    got = {r[0]: (r[1] or [], r[2]) for r in entities.repeat_links(df, F.col("k"), "id", "t", 3).collect()}
    want = {}
    for i, k, t in data:
        if k is not None and t is not None:
            before = sorted(((u, j) for j, m, u in data if m == k and u is not None and u < t), reverse=True)
            want[i] = ([j for _, j in before[:3]], len(before))
    assert got == want


def test_null_keys_meet_and_promoted_keys_are_single(spark):
    t = spark.createDataFrame([(None, "x"), (1, "y")], "k int, v string")
    assert rows(changes.compare(t, t, ["k"], ["v"]), "k") == [(None, "same"), (1, "same")]
    assert rows(changes.upsert(t, spark.createDataFrame([(None, "z")], t.schema), ["k"]), "k") == [(None, "z"), (1, "y")]
    assert changes.replace_rows(t, t, ["k"]).count() == 2 and changes.insert_absent(t, t, ["k"]).count() == 2
    raw = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "n", 1), (None, "n", 1)], "k int, v string, at int")
    main = spark.createDataFrame([], "k int, v string, version_hash string, promoted_at int")
    once = changes.promote(raw, main, ["k"], ["v"], F.lit(1), "at")
    assert rows(once.select("k", "v"), "k") == [(None, "n"), (1, "new")]
    assert rows(changes.promote(raw, once, ["k"], ["v"], F.lit(2), "at").select("k", "promoted_at"), "k") == [(None, 1), (1, 1)]


def said(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, x string")


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_settlements_of_several_words(spark):
    df = said(spark, "Продаж, м. Біла Церква, центр", "с. Нові Петрівці", "4-кімнатна кв. 85 м.кв. поруч", "смт.Ворзель", "30 м. до зупинки")
    assert values(df, X.described_address(F.col("x"))["settlement"]) == ["Біла Церква", "Нові Петрівці", None, "Ворзель", None]


def test_districts_are_whole_words_in_the_order_of_the_text(spark):
    df = said(spark, "Кам'янець-Подільський", "Печерський або Деснянський район", "у Подільському районі", "Подільська вулиця", "в Соломʼянському")
    assert values(df, P.district_in_text(F.col("x"))) == [None, "Печерський", "Подільський", "Подільський", "Солом'янський"]


def test_houses_with_a_fraction(spark):
    df = said(spark, "просп. Перемоги 12/4", "вул. Тиха 7а", "вул. Січових Стрільців, 5-Б")
    got = [tuple(r) for r in df.orderBy("i").select(*P.street_and_house(F.col("x")).values()).collect()]
    assert got == [("Перемоги", "12/4"), ("Тиха", "7а"), ("Січових Стрільців", "5-Б")]


def test_regions_and_settlements_by_their_words(spark):
    df = said(spark, "на Вінниччині, Вінницькою областю", "продано Києву", "Київська область", "у Севастополі", "в Криму", None)
    told = {c: values(df, P.names_region(F.col("x"), c)) for c in ("Вінницька область", "м. Київ", "м. Севастополь", "АР Крим")}
    assert told == {"Вінницька область": [True, *[False] * 5], "м. Київ": [False, True, *[False] * 4], "м. Севастополь": [*[False] * 3, True, False, False], "АР Крим": [*[False] * 4, True, False]}
    assert values(said(spark, "до смт Ворзель", "в м.Київ", "з Умані", "На горі"), P.settlement_name(F.col("x"))) == ["Ворзель", "Київ", "Умані", "горі"]


def test_land_units_in_all_cases(spark):
    df = said(spark, "6 сотками", "по 10 соткам", "6 сот.", "8 сотці", "6 сотень")
    assert values(df, C.land_hectares(F.col("x"))) == [0.06, 0.1, 0.06, 0.08, None]
