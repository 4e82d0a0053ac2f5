"""Nulls, empty inputs and ties of table, call and throttle operators."""

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import calls, jobs, tables


def test_anchor_fallback(spark):
    items = [(1, 0, 0, b, x, x + 20, t) for b, x, t in ((0, 10.0, "a"), (0, 35.0, "b"), (0, 29.0, "7"), (1, 200.0, "c"))]
    df = spark.createDataFrame(items, "doc_id long, pno int, tbl int, band int, x0 double, x1 double, text string")
    got = [(r.band, r.text, r.conf) for r in tables.anchor_split(df).orderBy("band", "cell").collect()]
    assert got == [(0, "a", 0.4), (0, "7 b", 0.4), (1, "c", 0.4)]
    assert tables.anchor_split(df.where("false")).count() == 0


def test_throttle_counts_from_the_last_persisted(spark):
    rows = [(1, f"2024-01-01 {h:02d}:00:00", 1, "view") for h in range(1)] + [(h + 1, f"2024-01-01 {h:02d}:00:00", 1, "view") for h in (1, 2, 3, 4)] + [(9, "2024-01-01 05:00:00", 1, "stage")]
    df = spark.createDataFrame(rows, "event_id long, ts string, job long, kind string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.event_id for r in jobs.throttle(df, 7200).collect()) == [1, 3, 5, 9]
    assert jobs.throttle(df.where("false")).count() == 0


def test_ask_until_valid(spark):
    units = spark.createDataFrame([(1, "a [FORMULA_0]"), (2, "b"), (3, None)], "id long, text string")

    def ask(pending, attempt):
        full = F.col("text") if attempt == 2 else F.lit("x")
        return pending.select("id", F.concat(F.lit("> "), full).alias("dst"))

    got = {r.id: (r.dst, r.attempt) for r in calls.ask_until_valid(units, ask, 3).collect()}
    assert got == {1: ("> a [FORMULA_0]", 2), 2: ("> x", 1), 3: (None, None)}
    assert calls.ask_until_valid(units.where("false"), ask).count() == 0


def test_clean_text(spark):
    rows = [(" • one \n\n two\n", "one two"), ("中文\n接着 写", "中文接着写"), ("中\n文\n字", "中文字"), ("", ""), (None, None), ("a.\n(b", "a.(b")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", T.clean_text(F.col("t")))
    assert df.where("not (got <=> want)").collect() == []


def test_tables_and_formulas_are_one_fold(spark):
    """One sort for the items or spans of a page, whose memory is that of its rows, and no join of sorted copies."""
    from quillspark.plans.catalog import QUERIES

    for name in ("table_anchor_split", "display_formulas"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1 and "Join" not in plan and "Window" not in plan


def test_anchor_split_of_equal_items_and_null_texts(spark):
    rows = [(1, 0, 0, b, x, x + 10, t) for b, x, t in ((0, 10.0, "a"), (0, 10.0, "a"), (0, 100.0, "b"), (1, 11.0, None), (1, 100.0, "d"), (2, 10.0, "e"), (2, 50.0, "f"))] + [(1, 0, 0, None, 10.0, 20.0, "no row")]
    df = spark.createDataFrame(rows, "doc_id long, pno int, tbl int, band int, x0 double, x1 double, text string")
    got = [(r.band, r.cell, r.text, r.conf) for r in tables.anchor_split(df).orderBy("band", "cell").collect()]
    assert got == [(0, 0, "a a", 0.9), (0, 1, "b", 0.9), (1, 0, "", 0.9), (1, 1, "d", 0.9), (2, 0, "e", 0.7), (2, 1, "f", 0.7)]


def test_translation_looks_up_once_and_keeps_odd_units(spark):
    """Equal units, null texts and null documents stay; the cache is looked up once, and its join is no part of the results."""
    from quillspark.sources.files import Settings
    from quillspark.translate import translate_units

    rows = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 1, "a"), (1, 2, ""), (1, 3, "b"), (2, 0, "b"), (None, 0, "a"), (None, 1, "c")], "doc long, i int, text string")
    settings = Settings(provider="m", batch_size=2, batch_chars=0, max_calls=9)
    cache = spark.createDataFrame([("c", "C")], "text string, dst string").select(T.cache_key("x", "m", settings.source, settings.target, F.col("text")).alias("k"), "dst")
    done = translate_units(rows, cache, lambda units, attempt: units.select("id", F.concat(F.lit(">"), "text").alias("dst")), settings)
    got = sorted((repr(r.doc), r.i, r.text, r.dst, r.origin) for r in done.results.where("text is not null").collect())
    assert got == [("1", 1, "a", ">a", "call"), ("1", 1, "a", ">a", "call"), ("1", 2, "", ">", "call"), ("1", 3, "b", ">b", "call"), ("2", 0, "b", ">b", "call"), ("None", 0, "a", "a", "source"), ("None", 1, "c", "C", "cache")]
    assert done.results.count() == 8 and sorted((r.src, r.dst) for r in done.cache.collect()) == [("", ">"), ("a", ">a"), ("b", ">b")]
    assert "__d0" not in done.results._jdf.queryExecution().optimizedPlan().toString()
