"""SQL functions, table functions and subscribers of streaming progress."""

from quillspark import extensions


def test_registered_functions(spark):
    extensions.register_functions(spark)
    assert spark.sql("SELECT text_alike('Method Value', 'method values') AS x").first().x > 0.9
    assert spark.sql("SELECT upper_median(x) AS m FROM VALUES (1D), (4D), (2D), (null), (3D) AS t(x)").first().m == 3.0
    rows = spark.sql("""SELECT * FROM reply_pairs('{"1": "a", "2": "b', array('1', '2'))""").collect()
    assert [tuple(r) for r in rows] == [("1", "a")] or rows == []
    assert spark.sql("SELECT * FROM reply_pairs(null, array('1'))").count() == 0


def test_subscribers():
    told, s = [], extensions.Subscribers()

    def broken(event):
        raise RuntimeError("gone")

    leave = s.subscribe(told.append)
    s.subscribe(broken)
    s.tell({"kind": "a"})
    s.tell({"kind": "b"})
    leave()
    leave()
    s.tell({"kind": "c"})
    assert [e["kind"] for e in told] == ["a", "b"] and s._told == []
