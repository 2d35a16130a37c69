"""Every query runs over a whole small table and returns the columns agreed on."""

import pytest
from compare import duck_rows, spark_rows

from roadpulse.llm.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_topk": "query_id rank vec_id score",
    "op2_embedding_neardup": "vec_id n_links component_id kept",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256 text",
    "op5_mixing": "doc_id size source_size target taken",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_toxicity": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = queries()[name](spark, SF)
    assert df.columns == COLUMNS[name].split()
    names, rows = spark_rows(df)
    assert rows
    if sql := oracle_sql().get(name):
        assert (names, rows) == duck_rows(sql, SF)
    if name not in ("op1_topk", "op2_embedding_neardup", "op9_packing"):
        assert rows.total() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_all_are_covered():
    assert set(COLUMNS) == set(queries())
