"""The pipeline against a version that looks at every pair of documents."""

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
from conftest_llm import brute_components
from test_dedup import brute_lines

from quillspark.llm import decontaminate, pieces, textbatch
from quillspark.llm.queries import PIECES


def test_pipeline_equals_brute_force(spark, sf, docs):
    import pandas as pd

    texts = {r.doc_id: r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    gone, left = brute_lines(texts)
    whole = {i: t for i, t in texts.items() if len(gone[i]) < len(t.split("\n"))}
    part, _ = brute_components(whole, 5, 80)
    assert any(part[i] != i for i in whole)
    texts = {i: left[i] for i in whole if part[i] == i}
    part, _ = brute_components(texts, 5, 80)
    texts = {i: t for i, t in texts.items() if part[i] == i}
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}))
    c.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    leaked = {r[0] for r in c.sql(f"SELECT doc_id FROM ({decontaminate.ORACLE})").fetchall()}
    texts = {i: t for i, t in texts.items() if i not in leaked}
    model = pieces.PieceModel.load(PIECES)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(texts) and leaked
    ids, per, _ = model.encode(*textbatch.text_bytes(pa.array(list(texts.values()))))
    at = np.concatenate([[0], np.cumsum(per)])
    for k, (i, t) in enumerate(texts.items()):
        assert got[i].ids == ids[at[k] : at[k + 1]].tolist() and got[i].round_trip and model.decode(got[i].ids) == t


def test_stages_take_empty_tables(spark, sf, docs):
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
