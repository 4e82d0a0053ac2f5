"""Queries over folds of a page's lines and over replies, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import folds
from quillspark.plans.registry import query
from quillspark.sources.adapters import LINES_SQL, page_lines, table

@query("ocr_vote", LINES_SQL + """, e AS (SELECT doc_id, pno, CAST(row_number() OVER (PARTITION BY doc_id, pno ORDER BY pi) - 1 AS INTEGER) AS i, pi, text FROM v)
SELECT doc_id, pno, i, CASE WHEN pi % 5 <> 3 AND pi % 2 = 1 THEN CASE WHEN pi % 4 = 1 THEN text || '!' ELSE replace(text, ' ', '  ') END ELSE text END AS text, CASE WHEN pi % 5 <> 3 AND pi % 2 = 1 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS score, pi % 5 <> 3 AND pi % 4 = 1 AND pi % 2 = 1 AS conflict FROM e""")
def ocr_vote(spark, d):
    """Two engines: the second one's lines lie 1 point lower (every fifth one elsewhere), read more or less surely, with wider spaces or a mark more."""
    b, p, t = F.col("bbox"), F.col("pi"), F.col("text")
    lines = page_lines(table(spark, d, "documents"))
    first = lines.select("doc_id", "pno", F.lit("a").alias("engine"), p.alias("i"), "bbox.*", "text", F.lit(0.8).alias("score"))
    down = F.when(p % 5 == 3, 5000).otherwise(1)
    other = F.when(p % 4 == 1, F.concat(t, F.lit("!"))).otherwise(F.replace(t, F.lit(" "), F.lit("  ")))
    second = lines.select("doc_id", "pno", F.lit("b"), p, b.x0, b.y0 + down, b.x1, b.y1 + down, other, F.when(p % 2 == 1, 0.9).otherwise(0.7))
    return folds.ocr_vote(first.union(second))


@query("pair_parse", """SELECT id, unnest(ks) AS key, unnest(vs) AS text FROM (SELECT conv_id * 1000 + turn AS id, CASE turn % 5 WHEN 0 THEN ['1', '2'] WHEN 1 THEN ['1'] WHEN 3 THEN ['1'] END AS ks,
CASE turn % 5 WHEN 0 THEN ['a' || conv_id, 'b'] WHEN 1 THEN ['cut, "quoted" ' || turn] WHEN 3 THEN ['x'] END AS vs FROM conversations) WHERE ks IS NOT NULL""")
def pair_parse(spark, d):
    text = lambda c: F.col(c).cast("string")
    k = F.col("turn") % 5
    raw = F.when(k == 0, F.concat(F.lit('{"1": "a'), text("conv_id"), F.lit('", "2": "b"}'))).when(k == 1, F.concat(F.lit('{"1": "cut, \\"quoted\\" '), text("turn"), F.lit('", "2": "b'))).when(k == 2, "no reply").when(k == 3, 'so: {"1": "x", "9": "z"} end')
    return folds.pair_parse(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), raw.alias("raw"), F.array(F.lit("1"), F.lit("2")).alias("wanted")))


@query("ocr_line_blocks", LINES_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pno ORDER BY y0, x0, pi) AS s FROM v),
w AS (WITH RECURSIVE g AS (
  SELECT doc_id, pno, s, [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'n': 1}] AS bs FROM n WHERE s = 1
  UNION ALL
  SELECT doc_id, pno, s, CASE WHEN p > 0 THEN list_transform(range(1, len(bs) + 1), lambda k: CASE WHEN k = p THEN {'x0': least(bs[k].x0, x0), 'y0': least(bs[k].y0, y0), 'x1': greatest(bs[k].x1, x1), 'y1': greatest(bs[k].y1, y1), 'n': bs[k].n + 1} ELSE bs[k] END)
    ELSE list_append(bs, {'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'n': 1}) END
  FROM (SELECT g.doc_id, g.pno, n.s, n.x0, n.y0, n.x1, n.y1, g.bs, coalesce(list_position(list_transform(g.bs, lambda b: (least(n.x1, b.x1) - greatest(n.x0, b.x0)) / greatest(1.0, least(n.x1 - n.x0, b.x1 - b.x0)) > 0.35::DOUBLE AND n.y0 - b.y1 >= -12 AND n.y0 - b.y1 < 1.8::DOUBLE * 12), true), 0) AS p
    FROM g JOIN n ON n.doc_id = g.doc_id AND n.pno = g.pno AND n.s = g.s + 1)
) SELECT * FROM g)
SELECT doc_id, pno, CAST(k - 1 AS INTEGER) AS block, bs[k].x0 AS x0, bs[k].y0 AS y0, bs[k].x1 AS x1, bs[k].y1 AS y1, CAST(bs[k].n AS INTEGER) AS n_lines
FROM (SELECT w.*, unnest(range(1, len(bs) + 1)) AS k FROM w JOIN (SELECT doc_id, pno, max(s) AS s FROM n GROUP BY 1, 2) USING (doc_id, pno, s))""")
def ocr_line_blocks(spark, d):
    lines = page_lines(table(spark, d, "documents")).select("doc_id", "pno", "pi", "bbox.*")
    return folds.ocr_line_blocks(lines)
