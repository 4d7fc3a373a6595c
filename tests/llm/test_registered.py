"""The registered queries of this subpackage, run as they are on the smallest tables."""

import duckdb
import pytest

from tessella.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLE = {"op2_extract": "pages"}


@pytest.mark.parametrize("name", ["op1_topk", "op9_ngram_join", "op13_merkle"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = queries()[name](spark, SF).toPandas(), c.execute(oracle_sql()[name]).df()
    cols = sorted(theirs.columns)
    assert sorted(map(str, ours[cols].values.tolist())) == sorted(map(str, theirs[cols].values.tolist()))


@pytest.mark.parametrize("name", ["op2_extract", "op3_language", "op4_toxicity", "op5_sentencepiece", "op6_mixing", "op7_pii", "op8_token_codes", "op11_simhash", "op12_periods"])
def test_a_row_for_each_row(spark, name):
    table = spark.read.parquet(f"{SF}/{TABLE.get(name, 'documents')}.parquet")
    key = table.columns[0]
    got = sorted(r[0] for r in queries()[name](spark, SF).select(key).collect())
    assert got == sorted(r[0] for r in table.select(key).collect())


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_an_empty_table(spark, tmp_path, stage):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path)).count() == 0


def test_pipeline_as_registered(spark):
    """All stages over whole tables: known documents only, none without a word, ids that decode to their texts."""
    import __spark_entry__ as entry

    known = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    rows = entry.queries()["pipeline"](spark, SF).select("doc_id", "parity", "round_trip").collect()
    assert len(rows) > 50 and {r.doc_id for r in rows} <= known and all(r.parity and r.round_trip for r in rows)
