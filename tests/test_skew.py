"""Hot keys: one buyer/supplier pair holding most rows, a hot null group and
a hot duplicated award id give the same results as a plain computation."""
from collections import Counter

from bidlens.operators import features as feat
from bidlens.operators import scoring

TEN = "tender_id string, buyer_name string, main_category string, tender_date string"
AW = "award_id string, tender_id string, supplier_id string, supplier_name string, amount double, date string, pos long"


def test_hot_pair_and_null_group(spark):
    n = 3000
    tenders = [("T0", "HOT", "goods", None), ("T1", None, None, None)] + [(f"T{i}", f"B{i}", "works", None)
                                                                       for i in range(2, 50)]
    awards = []
    for i in range(n):
        t = "T0" if i % 3 else ("T1" if i % 2 else f"T{2 + i % 48}")
        s = "S0" if t == "T0" else (None if t == "T1" else f"S{i % 7}")
        awards.append((f"A{i % 2500}", t, s, "x", float(i % 97), None, i))
    t = spark.createDataFrame(tenders, TEN).repartition(5)
    a = spark.createDataFrame(awards, AW).repartition(11)
    got = {r.award_id: r for r in feat.build_features(t, a, ["pos"]).collect()}
    # plain Python reference of the share rule (first row per award id)
    buyer = {x[0]: x[1] for x in tenders}
    rows = [(aid, buyer[tid], sid, pos) for aid, tid, sid, _, _, _, pos in awards]
    pair = Counter((b, s) for _, b, s, _ in rows)
    tot = Counter(b for _, b, _, _ in rows)
    first = {}
    for aid, b, s, pos in sorted(rows, key=lambda r: r[3]):
        first.setdefault(aid, (b, s))
    assert len(got) == len(first) == 2500
    for aid, (b, s) in first.items():
        assert abs(got[aid].award_concentration_by_buyer - pair[(b, s)] / tot[b]) < 1e-12


def test_hot_award_id_in_batch(spark):
    feats = spark.createDataFrame([("A1", "S1", 1.0, 1.0, 2.0, 1, 5)] * 50 + [("A2", "S2", 0.0, 0.0, 0.0, 0, 0)],
                                  "award_id string, supplier_id string, award_concentration_by_buyer double, "
                                  "repeat_winner_ratio double, amount_zscore_by_category double, "
                                  "near_threshold_flag int, time_to_award_days int")
    req = spark.createDataFrame([(i, "A1" if i % 10 else "A2", None) for i in range(5000)],
                                "input_row_id long, award_id string, supplier_id string").repartition(9)
    out = scoring.score_batch(req, feats)
    assert out.count() == 5000  # one output row per request, no fan-out from duplicated features
    assert out.filter("award_id = 'A1' AND abs(risk_score - 0.933333) < 1e-9").count() == 4500
