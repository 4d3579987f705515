import json

import pytest

from bidlens.operators import scoring
from bidlens.sources import requests as rq


def test_payload_shapes_f8(spark):
    p = spark.createDataFrame([
        (1, json.dumps([{"award_id": "A1"}, {"award_id": "A2"}])),
        (2, json.dumps({"items": [{"award_id": "A1", "supplier_id": "S9"}, 7]})),
        (3, json.dumps({"other": []})),
        (4, "  [] "),
        (5, json.dumps("just text"))], "payload_id long, payload string")
    rows = sorted((r.payload_id, r.input_row_id, r.award_id, r.supplier_id)
                  for r in rq.parse_request_payloads(p).collect())
    assert rows == [(1, 0, "A1", None), (1, 1, "A2", None), (2, 0, "A1", "S9"), (2, 1, None, None)]
    capped = rq.parse_request_payloads(p, max_items=1).collect()
    assert sorted(r.payload_id for r in capped) == [1, 2]


def test_coerce_award_rows(spark):
    df = spark.createDataFrame([(0, " A1", "S1"), (1, "NaN", None)], "input_row_id long, `Award ID` string, SUPPLIER_ID string")
    out = {r.input_row_id: r for r in rq.coerce_award_rows(df).collect()}
    assert out[0].award_id == " A1" and out[0].supplier_id == "S1" and out[1].award_id is None
    with pytest.raises(ValueError):
        rq.coerce_award_rows(spark.createDataFrame([(1,)], "x long"))


def test_record_input_range_checks(spark):
    df = spark.createDataFrame([(-1.0, 0, 0), (5.0, -2, -1), (5.0, 1, 1)],
                               "amount double, past_awards_count long, adverse_media_count long")
    errs = [r.error for r in scoring.record_input_errors(df).collect()]
    assert errs[0] == "amount must be >= 0"
    assert errs[1] == "past_awards_count must be >= 0; adverse_media_count must be >= 0"
    assert errs[2] is None
