import numpy as np
import pytest

from bidlens.operators import evaluate as ev
from bidlens.operators import model as mdl
from bidlens.operators.features import FEATURE_COLS

F9 = [(0.1, 0.0, 0.2, 0.0, 10.0), (0.9, 0.95, 3.0, 1.0, 120.0), (0.8, 0.8, 2.5, 1.0, 90.0), (0.2, 0.1, 0.1, 0.0, 15.0)]
DDL = ", ".join(f"{c} double" for c in FEATURE_COLS)


def _newton(X, y, C=1.0, iters=100):
    """sklearn's objective: ½‖w‖² + C·Σ logloss, intercept unpenalised."""
    n, d = X.shape
    Xb = np.hstack([X, np.ones((n, 1))])
    w = np.zeros(d + 1)
    reg = np.eye(d + 1)
    reg[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ w))
        g = C * Xb.T @ (p - y) + reg @ w
        H = C * (Xb.T * (p * (1 - p))) @ Xb + reg
        w -= np.linalg.solve(H, g)
    return w[:-1], w[-1]


def test_fit_matches_newton_solve(spark):
    rows = F9 * 3 + [(0.5, 0.4, 1.0, 0.0, 30.0), (0.3, 0.9, 0.0, 0.0, 60.0)]
    df = spark.createDataFrame(rows, DDL)
    lm = mdl.fit(df)
    X = np.array(rows, dtype=float)
    y = np.array([int(r[2] > 1.5 or r[1] > 0.8 or r[3] == 1 or r[0] > 0.7) for r in rows])
    w, b = _newton(X, y)
    assert np.allclose(lm.coef, w, atol=2e-3)
    assert lm.intercept == pytest.approx(b, abs=2e-3)


def test_probabilities_and_explanations_f9(spark):
    df = spark.createDataFrame(F9, DDL)
    lm = mdl.fit(df)
    from bidlens.operators.scoring import linear_score
    rows = linear_score(df, lm, top_k=None).collect()
    for r in rows:
        assert 0.0 <= r.risk_score <= 1.0
        assert len(r.top_factors) == 5
    top3 = [f.name for f in rows[1].top_factors[:3]]
    assert "repeat_winner_ratio" in top3 or "amount_zscore_by_category" in top3


def test_band_thresholds_match_numpy(spark):
    vals = [0.1, 0.5, 0.2, 0.9, 0.9, 0.3, 0.7, 0.05, 0.6, 0.45, 0.33]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "p double")
    th = mdl.band_thresholds(df, "p")
    assert th["low_max"] == pytest.approx(float(np.quantile(vals, 0.33)), abs=1e-12)
    assert th["medium_max"] == pytest.approx(float(np.quantile(vals, 0.66)), abs=1e-12)
    assert mdl.band_thresholds(spark.createDataFrame([], "p double"), "p") == {"low_max": 0.33, "medium_max": 0.66}


def test_proxy_label_missing_columns(spark):
    df = spark.createDataFrame([(2.0,), (0.0,), (None,)], "amount_zscore_by_category double")
    assert [r.label for r in mdl.proxy_label(df).collect()] == [1, 0, 0]


def _brute_metrics(y, p):
    y, p = np.array(y), np.array(p)
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap = 0.0
    for t in sorted(set(p), reverse=True):
        sel = p >= t
        prec = y[sel].mean()
        rec_now = y[sel].sum() / y.sum()
        rec_prev = y[p > t].sum() / y.sum()
        ap += (rec_now - rec_prev) * prec
    pc = np.clip(p, 1e-6, 1 - 1e-6)
    return dict(auc_roc=auc, avg_precision=ap, brier=np.mean((p - y) ** 2),
                log_loss=-np.mean(y * np.log(pc) + (1 - y) * np.log(1 - pc)), pos_rate=y.mean(), n=len(y))


@pytest.mark.parametrize("bucket_rows", [None, 3])
def test_metrics_match_brute_force(spark, bucket_rows, monkeypatch):
    if bucket_rows:
        import bidlens.operators.ranking as rk
        monkeypatch.setattr(rk, "ROWS_PER_BUCKET", bucket_rows)
        monkeypatch.setattr(ev, "prefix_sums", lambda df, o, c: rk.prefix_sums(df, o, c, bucket_rows))
    rng = np.random.default_rng(7)
    p = np.round(rng.random(60), 1)  # many ties
    y = (rng.random(60) < p).astype(int)
    df = spark.createDataFrame([(int(a), float(b), i) for i, (a, b) in enumerate(zip(y, p))], "label int, p double, k int")
    got = ev.metrics(df, "label", "p", order="k").first().asDict()
    exp = _brute_metrics(y, p)
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


def test_metrics_f10_and_degenerate(spark):
    df = spark.createDataFrame([(1, 0.8, 0), (0, 0.2, 1), (1, 0.6, 2)], "label int, p double, k int")
    m = ev.metrics(df, "label", "p", order="k").first()
    assert m.n == 3 and 0 <= m.brier <= 1 and m.auc_roc == 1.0
    same = spark.createDataFrame([(1, 0.8, 0), (1, 0.2, 1), (1, 0.6, 2)], "label int, p double, k int")
    m = ev.metrics(same, "label", "p", order="k").first()  # first label flipped to 0
    assert m.pos_rate == pytest.approx(2 / 3) and m.auc_roc == 0.0


def test_calibrate_and_persist(spark, tmp_dir):
    df = spark.createDataFrame(F9 * 5, DDL)
    lm = mdl.fit(df)
    cal = mdl.calibrate(df, lm)
    assert cal.calibration is not None
    mdl.save_model(spark, cal, tmp_dir + "/m")
    back = mdl.load_model(spark, tmp_dir + "/m")
    assert back.coef == pytest.approx(cal.coef) and back.calibration == pytest.approx(cal.calibration)
    assert mdl.load_model(spark, tmp_dir + "/missing") is None
    w = mdl.top_weights(spark, lm, n=3).collect()
    assert len(w) == 3 and abs(w[0].weight) >= abs(w[1].weight)
