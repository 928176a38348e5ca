"""The pipeline's stages and the registered queries' SQL."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline as cp
from tests.llm.conftest import edge_rows
from tests.llm.test_dedup import groups, removed
from tests.llm.test_text_quality import _base

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    frames = [docs.toPandas()]
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(frames[-1]) if frames[-1] is not frames[0] else docs
        frames.append(stage(spark, docs, SMALL).toPandas())
    assert all(f.columns.tolist() == list(cp.COLUMNS) for f in frames[:-1])
    start, named, ruled, single, stripped, packed = frames
    assert len(named) == len(start)                     # every document is in one of four languages
    assert set(ruled.doc_id) <= {i for i, t in zip(named.doc_id, named.text, strict=True) if not _base(t)[-1]}
    labels = pd.read_parquet(f"{SMALL}/labels.parquet").set_index("doc_id").quality
    assert not labels.reindex(ruled.doc_id).eq(0).any()
    keep = {c for _, _, c in groups(ruled.doc_id.tolist(), ruled.text.tolist(), 5, 80)}
    assert sorted(single.doc_id) == sorted(keep)
    gone = dict(zip(single.doc_id, removed(single.text.tolist(), cp.REPEAT_BYTES), strict=True))
    after = dict(zip(stripped.doc_id, stripped.text, strict=True))
    assert set(after) == set(gone)
    assert all(0 <= n - cut - len(after[i].encode()) <= 6 * spans for i, (n, cut, spans, _) in gone.items())
    assert (stripped.n_chars == stripped.text.str.len()).all()
    assert set(packed.doc_id) == set(after) and (packed.groupby("sequence_id").length.sum() <= 4096).all()


def test_stages_on_edges(spark, docs, no_docs):
    for frame in (docs.select(*cp.COLUMNS), no_docs):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, frame, SMALL)
            assert out.columns == list(cp.COLUMNS)
            assert out.count() <= len(edge_rows())
        assert cp.STAGES[-1][1](spark, frame, SMALL).select("doc_id").distinct().count() <= len(edge_rows())


def test_run(spark):
    out = cp.run(spark, SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 100


def _sql():
    from outletlens.llm.queries import ORACLES
    return sorted(ORACLES)


@pytest.mark.parametrize("name", _sql())
def test_sql_twins(spark, name):
    from outletlens.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    mine, sql = QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(sql.columns)

    def rows(df):
        return sorted(df[cols].astype(object).where(df[cols].notna(), None).astype(str).itertuples(index=False, name=None))
    assert rows(mine) == rows(sql)


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
