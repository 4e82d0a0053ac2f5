"""Files, settings, engines, glossaries, wrapping and readings: small cases with known results, nulls and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import prompts, styles
from quillspark.functions import text as T
from quillspark.functions.geom import rect
from quillspark.operators import boxes, caching, control, glossaries, links, splits, units, wrapping
from quillspark.sources import files, readings


def test_binary_documents_and_depth(spark, tmp_path):
    for name in ("a.txt", "x/b.txt", "x/y/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = files.binary_documents(spark, str(tmp_path), "*.txt", 1).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["a.txt", "b.txt"] and all(len(r.fingerprint) == 32 for r in got)
    assert files.binary_documents(spark, str(tmp_path), "*.txt").count() == 3


def test_event_lines_in_and_out(spark, tmp_path):
    rows = ['{"kind": "stage", "job": 1, "stage": "layout"}', "not json", '{"job": 2}', "", '{"kind": "done", "job": 1, "done": 3}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(rows))
    q = files.write_events(files.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    got = spark.read.json(str(tmp_path / "out")).select("kind", "job").collect()
    assert sorted(map(tuple, got)) == [("done", 1), ("stage", 1)]
    frame = files.sse_frames(spark.createDataFrame([(7, "done", 3)], "eid long, kind string, n int")).first().frame
    assert frame == 'id: 7\ndata: {"kind":"done","n":3}\n\n'


def test_control_files_and_atomic_writes(tmp_path):
    assert files.new_commands("pause\nres", 0) == (["pause"], 6) and files.new_commands("pause\nresume\n", 6) == (["resume"], 13)
    assert files.new_commands("", 0) == ([], 0)
    path = tmp_path / "out.pdf"
    files.write_atomically(str(path), b"one")
    files.write_atomically(str(path), b"two")
    assert path.read_bytes() == b"two" and [p.name for p in tmp_path.iterdir()] == ["out.pdf"]


def test_settings():
    s = files.Settings.load('{"overlap": true, "models": ["a", "b"], "pages": "1-2"}')
    assert (s.overlap, s.models, s.mode) == ("on", ("a", "b"), "faithful") and s.overlaps(True, 1) and not s.overlaps(False, 99)
    assert files.Settings.load("").overlaps(True, 12) and not files.Settings.load("").overlaps(True, 11) and not files.Settings.load('{"overlap": false}').overlaps(True, 99)
    for bad in ('{"mode": "x"}', '{"nothing": 1}', "[]", '{"mode": "reflow", "bilingual": true}', '{"batch_size": -1}', '{"batch_size": "x"}'):
        with pytest.raises(ValueError):
            files.Settings.load(bad)


def test_engines():
    def missing():
        raise ImportError("no such engine")

    e = files.Engines("own")
    e.add("own", lambda: "here")
    e.add("other", missing)
    assert e.get("other") == ("here", True) and e.get("own") == ("here", False) and not e.available("other")
    with pytest.raises(ValueError):
        files.Engines("none").get("x")


def test_glossaries(spark, tmp_path):
    text = '# terms\n---\nspin: Spin\n"yes": ja\nn: 5\nq: "5"\nb: true\nspin: Drehung # again\n\n'
    assert glossaries.parse_glossary(text) == [(3, "spin", "Spin"), (4, "yes", "ja"), (5, "n", None), (6, "q", "5"), (7, "b", None), (8, "spin", "Drehung")]
    with pytest.raises(ValueError):
        glossaries.parse_glossary("no colon here")
    terms = [("a b", "c"), ("yes", "no"), ("x:y", "5"), ("k", "a # b")]
    assert [(k, v) for _, k, v in glossaries.parse_glossary(glossaries.dump_terms(terms))] == terms
    (tmp_path / "deep" / "er" / "est").mkdir(parents=True)
    for name in ("b.yaml", "deep/a.yml", "deep/er/c.json", "deep/er/est/d.yaml", "e.txt"):
        (tmp_path / name).write_text("k: v\n")
    found = glossaries.glossary_files(str(tmp_path))
    assert [p.removeprefix(str(tmp_path)) for p in found] == ["/b.yaml", "/deep/a.yml", "/deep/er/c.json"]
    got = glossaries.merged_terms(files.glossary_table(spark, found)).collect()
    assert [(r.term, r.dst, r.n) for r in got] == [("k", "v", 3)]


def test_wrap():
    one = lambda c: wrapping.char_width(c, 10.0)
    assert wrapping.wrap("alpha beta gamma", 55, one) == ["alpha beta", "gamma"] and wrapping.wrap("alpha beta gamma", 52, one) == ["alpha beta", "gamma"]
    assert wrapping.wrap("一二三四，五", 40, one) == ["一二三四", "，五"] and wrapping.wrap("一二三（四五", 40, one) == ["一二三", "（四五"]
    assert wrapping.wrap("abcdefghij", 20, one) == ["abcd", "efgh", "ij"] and wrapping.wrap("", 20, one) == [] and wrapping.wrap("  \n ", 20, one) == []
    text = "mixed 中文 text, with some（brackets）and words and 数字 123 " * 5
    for width in (60, 90, 200):
        lines = wrapping.wrap(text, width, one)
        assert "".join(lines).replace(" ", "") == text.replace(" ", "") and all(sum(map(one, x)) <= width * 1.02 for x in lines)


def test_wrapped_table(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "id long, text string")
    assert [(r.id, r.i, r.line) for r in wrapping.wrapped(df, "id", 30, 10.0).orderBy("i").collect()] == [(1, 0, "alpha"), (1, 1, "beta")]
    assert wrapping.wrapped(df.where("false"), "id", 30, 10.0).count() == 0


def test_loose_find_and_wrap_links(spark):
    rows = [("see （3） and ( 3 ) there", "(3)", 0, (4, 7)), ("see （3） and ( 3 ) there", "(3)", 8, (12, 17)), ("only here", "on ly", 5, (0, 4)), ("abc", "", 0, None), ("", "x", 0, None), (None, "x", 0, None), ("abc", "z", 0, None)]
    df = spark.createDataFrame([(i, t, p, s) for i, (t, p, s, _) in enumerate(rows)], "i int, t string, p string, s int")
    got = {r.i: tuple(r.x) if r.x else None for r in df.select("i", links.find_loose(F.col("t"), F.col("p"), F.col("s")).alias("x")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(rows)}
    spans = spark.createDataFrame([("a<b", [(0, 1, "u"), (None, None, "v")]), ("ab", [])], "t string, s array<struct<s:int,e:int,href:string>>")
    assert [r[0] for r in spans.select(links.wrap_links(F.col("t"), F.col("s"))).collect()] == ['<a href="u">a</a>&lt;b', "ab"]


def test_call_control_on_odd_rows(spark):
    errors = spark.createDataFrame([(None,), ("429",), ("Retry in 100 s",), ("retry in x s",)], "e string")
    got = errors.select(control.rate_limited(F.col("e")), control.daily_quota(F.col("e")), control.retry_delay(F.col("e"), 60.0)).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (True, False, None), (False, False, 60.0), (False, False, None)]
    assert control.fallback_chain("a", " a, ,b,b,a") == ["a", "b", "a"] and control.fallback_chain("a", "") == ["a"]
    q = spark.createDataFrame([(1, i, c) for i, c in enumerate(["finish", "cancel", *["submit"] * 7, "cancel", "finish"])], "m long, i int, cmd string")
    got = [(r.outcome, r.waiting) for r in control.waiting_jobs(q, "m", ["i"]).orderBy("i").collect()]
    assert got == [("ignored", 0), ("ignored", 0), ("started", 0), *(("queued", k) for k in range(1, 6)), ("rejected", 5), ("cancelled", 4), ("next", 3)]
    assert control.waiting_jobs(q.where("false"), "m", ["i"]).count() == 0


def test_caches_on_odd_rows(spark, tmp_path):
    codec = spark.createDataFrame([('{"__rect__":[1,2,3,4]}',), ('{"__rect__":[1,2]}',), ('{"__rect__":[1,2,3,4],"x":[1]}',), ("bad",), (None,)], "t string")
    assert [r[0] for r in codec.select(caching.decode_rect(F.col("t")).x1).collect()] == [3.0, None, None, None, None]
    cache = spark.createDataFrame([("a", "1")], "k string, dst string")
    assert caching.merge_legacy(cache, [cache.withColumn("k", F.lit("b"))]).count() == 1 and caching.merge_legacy(cache.where("false"), []).count() == 0
    assert caching.cache_root("", str(tmp_path / "in.pdf"), "/out") == tmp_path and str(caching.cache_root("", "/nowhere/in.pdf", "/out")) == "/out" and str(caching.cache_root("/c", "x", "y")) == "/c"


def test_first_fit_equals_a_plain_search(spark):
    import random

    random.seed(3)
    rows = [(k, i, random.choice([0, 5, 40, 90, 101, 300])) for k in range(4) for i in range(120)]
    for budget, size in ((100, 4), (0, 3), (100, 1)):
        want = set()
        for k in range(4):
            bins = []
            for _, i, n in (r for r in rows if r[0] == k):
                at = next((b for b in bins if len(b[1]) < size and (budget == 0 or b[0] + n <= budget)), None)
                if at is None:
                    bins.append(at := [0, []])
                at[0] += n
                at[1].append(i)
            want |= {(k, b, c, len(x), ",".join(map(str, x))) for b, (c, x) in enumerate(bins)}
        got = units.first_fit(spark.createDataFrame(rows, "k long, i int, n int"), ["k"], "i", "n", budget, size)
        assert {tuple(r) for r in got.collect()} == want
    assert units.first_fit(spark.createDataFrame([], "k long, i int, n int"), ["k"], "i", "n", 100, 4).count() == 0


def test_over_bytes_equals_a_plain_search(spark):
    rows = [(k, (i * 37) % 501, i % 7) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, i long, n long")
    want = set()
    for k in range(3):
        mine = sorted((i, n) for g, i, n in rows if g == k)
        over = sum(n for _, n in mine) - 100
        for i, n in mine:
            if over > 0:
                want.add((k, i, n))
                over -= n
    for pieces in (1, 7, 1024):
        assert {tuple(r) for r in units.over_bytes(df, ["k"], F.col("n"), ["i"], 100, pieces).collect()} == want


def test_readings(spark):
    old = [[[[[0, 0], [10, 0], [10, 5], [0, 5]], ["t", 0.5]], [[[0, 0]], ["u", "bad"]]]]
    new = {"rec_texts": ["a", "", "b", "c"], "rec_boxes": [[0, 0, 1, 0, 1, 1, 0, 1], [], [0, 0], [[2, 2], [3, 2], [3, 3], [2, 3]]], "rec_scores": [0.1, 0.2, 0.3]}
    df = spark.createDataFrame([(1, json.dumps(old)), (2, json.dumps({"x": [new]})), (3, None), (4, "{")], "id long, result string")
    got = sorted((r.id, r.i, r.text, r.score, r.x1) for r in readings.normalised(df, "id").collect())
    assert got == [(1, 0, "t", 0.5, 10.0), (2, 0, "a", 0.1, 1.0), (2, 1, "c", 1.0, 3.0)]
    assert readings.normalised(df.where("false"), "id").count() == 0


def test_styles_and_prompts(spark):
    df = spark.createDataFrame([("IV. FINITE ELEMENTS",), ("IV. Finite elements",), ("123",), (None,), ("X " + "A" * 70,)], "t string")
    assert [r[0] for r in df.select(styles.section_title(F.col("t"))).collect()] == [True, False, False, None, False]
    keys = spark.createDataFrame([("sk-1234567890abcd",), ("short",), ("",), (None,)], "k string")
    assert [r[0] for r in keys.select(prompts.masked(F.col("k"))).collect()] == ["sk-123***abcd", "***", "", ""]
    flags = spark.createDataFrame([("汉",), ("かな",), ("Über",), ("123",)], "t string").select(prompts.has_cjk(F.col("t")), prompts.has_cjk(F.col("t"), False), prompts.has_letters(F.col("t"))).collect()
    assert [tuple(r) for r in flags] == [(True, True, False), (True, False, False), (False, False, True), (False, False, False)]


def test_runs_keep_the_union(spark):
    """A band is held against the whole run before it, not against its last piece."""
    rows = [(1, 0, 0, 0, "a", 0, 0, 100, 50), (1, 0, 0, 1, "b", 1, 40, 90, 45), (1, 0, 0, 2, "c", 2, 100, 80, 110), (1, 0, 1, 3, "d", 3, 112, 80, 120)]
    df = spark.createDataFrame([(*r[:5], *map(float, r[5:])) for r in rows], "doc_id long, pno int, hint int, i int, text string, x0 double, y0 double, x1 double, y1 double")
    bands = df.select("doc_id", "pno", "hint", "i", "text", rect(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("bbox"))
    assert [r.text for r in splits.merge_bands(bands).orderBy("run").collect()] == ["a b c", "d"]
    assert splits.merge_bands(bands.where("false")).count() == 0


def test_boxes_on_empty_pages(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0, "text", "Times", (0.0, 0.0, 50.0, 20.0))], "doc_id long, pno int, col int, i int, text string, font string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert boxes.display_formulas(spans).count() == 0 and boxes.display_formulas(spans.where("false")).count() == 0
    cells = spans.select("doc_id", "pno", "i", "bbox", "text")
    assert boxes.table_html(cells, ["doc_id", "pno"]).first().html is None
    wide = spark.createDataFrame([(1, 0, k, b, t) for k, (b, t) in enumerate((((0.0, 0.0, 90.0, 10.0), "head"), ((0.0, 20.0, 30.0, 30.0), "a<"), ((50.0, 21.0, 95.0, 30.0), ""), ((100.0, 20.0, 120.0, 30.0), "c")))], cells.schema)
    assert boxes.table_html(wide, ["doc_id", "pno"]).first().html == "<table><tr><td colspan=2>head</td></tr><tr><td>a&lt;</td><td>&#160;</td><td>c</td></tr></table>"


def test_list_labels(spark):
    rows = {"(1) one": "one", "1. two": "two", "• three": "three", "①four": "four", "（a） five": "five", "iv) six": "six", "plain": "plain", "12 seven": "seven"}
    df = spark.createDataFrame(list(rows.items()), "t string, want string")
    assert df.where(F.regexp_replace("t", T.LIST_LABEL, "") != F.col("want")).collect() == []
    assert [r.t for r in df.where(~F.col("t").rlike(T.LIST_ITEM)).collect()] == ["plain", "12 seven"]


def test_words_are_not_dealt_one_by_one(spark):
    """Words get their boxes without an exchange; sides are of lines, and parts of a line that stand apart are put in order."""
    lines = spark.createDataFrame([(1, 0, 0, "a  bc d", (10.0, 0.0, 50.0, 9.0)), (1, 0, 1, None, (10.0, 0.0, 50.0, 9.0)), (1, 0, 2, "  ", (0.0, 0.0, 5.0, 9.0))], "doc_id long, pno int, pi int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    words = splits.page_words(lines)
    assert [(r.pi, r.wi, r.word, r.bbox.x0, r.bbox.x1) for r in words.orderBy("pi", "wi").collect()] == [(0, 0, "a", 10.0, 15.0), (0, 1, "bc", 20.0, 30.0), (0, 2, "d", 35.0, 40.0)]
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()
    sides = splits.split_crossing(words, F.lit(612.0), F.lit(306.0))
    assert "Join" not in sides._jdf.queryExecution().executedPlan().toString()
    assert [(r.side, r.n_words, r.n_lines) for r in sides.collect()] == [(None, 3, 1)]
    read = [(1, 0, 0, 0, 0, x, 0, 8, 9, t, c) for x, t, c in ((30, " c ", 50), (10, "a", 100), (20, "b d", 0), (40, " ", 90), (50, "x", -1))]
    df = spark.createDataFrame([*read[:2], (1, 0, 0, 0, 1, 5, 0, 8, 9, "other", 70), *read[2:]], "doc_id long, pno int, block int, par int, line int, left int, top int, width int, height int, text string, conf int")
    got = readings.words_to_lines(df.coalesce(1), ["doc_id", "pno"])
    assert [(r.line, r.text, r.bbox.x0, r.bbox.x1, round(r.score, 6)) for r in got.orderBy("line").collect()] == [(0, "a b d c", 10.0, 38.0, 0.5), (1, "other", 5.0, 13.0, 0.7)]
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_loose_find_steps_by_word(spark):
    """Places are counted by runs, not by an array of a text's characters, and each step is made once."""
    text = "\x85 ab 　c d\U0001f600e\x0b f" * 50
    rows = spark.createDataFrame([(text, "d \U0001f600", 0), (text, "b c", 700), (text, "\x0bf\x85 a", 3), (text, "f" + text, 0)], "t string, p string, s int")
    df = rows.select(links.find_loose(F.col("t"), F.col("p"), F.col("s")).alias("x"))
    assert [tuple(r.x) if r.x else None for r in df.collect()] == [(8, 10), (3, 7), (13, 17), None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "(?s)." not in plan and plan.count("regexp_extract_all") == 1
