"""The pipeline's stages, one by one, against brute force on what each got."""

import brute
import pytest

import corpus_pipeline
from curalith.llm import bpe
from curalith.llm.queries import QUERIES
from curalith.llm.oracles import ORACLES


def test_stages(spark, make, rows, tmp_path):
    docs = make(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "repeats", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    def step(name, df):
        stages[name](spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == columns
        return out

    spoken = step("language", docs)
    assert {1001, 1002, 1003, 1008, 1012}.isdisjoint(text(spoken)) and 1009 in text(spoken)
    lined = step("lines", spoken)
    got = text(lined)
    for i, _, _, digest in brute.line_dedup(sorted(text(spoken).items())):
        assert brute.sha(got[i].encode()) == digest
    single = step("near_duplicates", lined)
    assert set(text(single)) == {i for i, _, c in brute.ngram_join(sorted(got.items())) if c == i}
    rest = step("repeats", single)
    left = text(rest)
    for i, _, removed, _, _ in brute.suffix_dedup(sorted(text(single).items())):
        assert len(left[i].encode()) <= len(text(single)[i].encode()) - removed
    packed = stages["packing"](spark, rest, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    shape = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert shape(whole) == shape(packed)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    found = con.sql(ORACLES[name])
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    want = sorted(tuple(dict(zip(found.columns, r, strict=True))[c] for c in columns) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_vocabulary_is_not_copied():
    assert "public_tokenizers" in bpe.vocabulary_path("word_bpe_49k.json")
