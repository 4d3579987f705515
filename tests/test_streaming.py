import json
import os

from bidlens.streaming import scoring as st

FEAT = ("award_id string, supplier_id string, award_concentration_by_buyer double, repeat_winner_ratio double, "
        "amount_zscore_by_category double, near_threshold_flag int, time_to_award_days int")


def test_stream_scoring_matches_batch(spark, tmp_dir):
    feats = spark.createDataFrame([("A1", "S1", 1.0, 1.0, 2.0, 1, 5), ("A2", "S2", 0.0, 0.0, -1.0, 0, 0)], FEAT)
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    reqs = [{"input_row_id": "0", "award_id": "A1"}, {"input_row_id": "1", "award_id": "A2"},
            {"input_row_id": "2", "award_id": ""}, {"input_row_id": "3", "award_id": "A9"}]
    with open(os.path.join(src, "part1.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in reqs[:2]))
    with open(os.path.join(src, "part2.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in reqs[2:]))
    q = st.score_request_stream(st.read_request_stream(spark, src, max_files_per_trigger=1), feats,
                                os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt"), available_now=True)
    q.awaitTermination(120)
    out = {r.input_row_id: r for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()}
    assert len(out) == 4
    assert abs(out["0"].risk_score - 0.933333) < 1e-9 and out["1"].risk_score == 0.0
    assert out["2"].error is not None and out["3"].error == "award_id not found in features"
