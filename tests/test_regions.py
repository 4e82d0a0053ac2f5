"""Folds over page regions that have no SQL twin."""

import pytest

from quillspark.operators import folds, regions
from quillspark.plans.catalog import QUERIES

LINE = "doc_id long, pno int, pi int, col int, text string, size double, x0 double, y0 double, x1 double, y1 double"


def test_paragraph_merge(spark):
    page = [
        ("Body of the first", 10.0, 50, 100, 300, 112), ("goes on here", 10.0, 50, 114, 290, 126), ("Far below", 10.0, 50, 200, 300, 212),
        ("Fig. 1 A caption", 10.0, 50, 214, 300, 226), ("after the caption", 10.0, 50, 228, 300, 240), ("small", 8.0, 50, 242, 300, 254),
        ("[1] A reference", 10.0, 50, 300, 300, 312), ("its second line", 10.0, 50, 330, 300, 342), ("[2] Another", 10.0, 50, 344, 300, 356),
        ("big outer block of text", 10.0, 50, 400, 300, 460), ("inner", 10.0, 100, 410, 150, 422),
    ]
    df = spark.createDataFrame([(1, 0, i, 0, t, s, *map(float, b)) for i, (t, s, *b) in enumerate(page)], LINE)
    got = [r.text for r in regions.paragraph_merge(df).orderBy("para").collect()]
    assert got == ["Body of the first\ngoes on here", "Far below", "Fig. 1 A caption", "after the caption", "small", "[1] A reference\nits second line", "[2] Another", "big outer block of text inner"]
    assert regions.paragraph_merge(df.where("false")).count() == 0


def test_paragraph_merge_keeps_all_text(spark):
    from quillspark.plans.catalog import QUERIES
    from quillspark.plans.layout_queries import lines_of

    sf = "/root/testdata/sf0.001"
    key = lambda r: (r.doc_id, r.pno)
    lines, paras = {}, {}
    for r in lines_of(spark, sf).collect():
        lines.setdefault(key(r), []).extend(r.text.split())
    merged = QUERIES["paragraph_merge"](spark, sf).collect()
    for r in merged:
        paras.setdefault(key(r), []).extend(r.text.split())
    assert {k: sorted(v) for k, v in lines.items()} == {k: sorted(v) for k, v in paras.items()}
    assert max(r.n_lines for r in merged) > 1


def test_toc_levels(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([3, 3, 3, 1, 4, 2])], "doc_id long, i int, level int")
    assert [r.toc for r in regions.toc_levels(df).orderBy("i").collect()] == [1, 2, 3, 1, 2, 2]


@pytest.mark.parametrize("name", ["paragraph_merge", "figure_regions", "ocr_vote", "pseudo_clusters"])
def test_pages_are_folded_along_the_partition(spark, name):
    """No call with a frame of its own for each page, and the same rows where batches end inside a page."""
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    want = sorted(map(tuple, df.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vote_of_engines(spark):
    """The engine with more lines leads, a line of another is used once, and null boxes and scores match nothing."""
    rows = [("b", 0, 0, 0, 10, 10, "x y", 0.5), ("b", 1, 0, 20, 10, 30, "two", 0.6), ("a", 0, 0, 1, 10, 11, "xy", 0.9), ("b", 2, 0, 0, 10, 10, "again", 0.1), ("c", 0, 0, 21, 10, 31, "Too", 0.2)]
    df = spark.createDataFrame([(1, 0, e, i, *map(float, b), t, s) for e, i, *b, t, s in rows] + [(None, 0, "a", 0, None, None, None, None, "z", None)], "doc_id long, pno int, engine string, i int, x0 double, y0 double, x1 double, y1 double, text string, score double")
    got = {(r.doc_id, r.i): (r.text, r.conflict) for r in folds.ocr_vote(df).collect()}
    assert got == {(1, 0): ("xy", False), (1, 1): ("two", True), (1, 2): ("again", False), (None, 0): ("z", False)}
