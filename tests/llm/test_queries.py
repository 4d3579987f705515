"""The registered queries run on sf0.001 and return their contract's columns."""
import os

import pytest

from bidlens.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
            "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
            "base_sha256": "string", "spans": "string"},
    "op5": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
            "slot": "bigint", "grown_shard": "int"},
    "op7": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10": {"doc_id": "bigint", "item_id": "bigint"},
    "op11": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string",
             "folded_root": "string", "verified": "boolean"},
    "op12": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op13": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
             "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
}


def test_one_query_per_operator():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(COLUMNS)
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.exists(SF), reason="test data missing")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    want = COLUMNS[name.split("_")[0]]
    assert {c: kinds[c] for c in want} == want
    n = df.count()
    if not name.startswith("op10"):
        t = "embeddings" if name.startswith("op5") else "documents"
        assert n == spark.read.parquet(f"{SF}/{t}.parquet").count()
