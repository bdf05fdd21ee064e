import numpy as np
import pytest

from tessera.functions import learners as L
from tessera.operators import balancing, metrics, scaling, thresholds

rng = np.random.default_rng(0)


@pytest.fixture(scope="module")
def blobs():
    centres, code = rng.normal(0, 2, (4, 8)), rng.integers(0, 4, 320)
    return centres[code] + rng.normal(0, 0.8, (320, 8)), np.array(list("abcd"), dtype=object)[code]


def test_scaler():
    x = np.array([[1.0, 5, 2], [3, 5, 4]])
    assert L.Scaler.fit(x)(x).tolist() == [[-1, 0, -1], [1, 0, 1]]
    assert L.gamma_of("auto", 1.0, 3) == 1 / 3 and L.gamma_of("0.5", 1.0, 3) == 0.5 and L.gamma_of("scale", 2.0, 5) == 0.1
    assert L.class_weights(np.array(["a", "a", "a", "b"])) == {"a": 4 / 6, "b": 2.0}


def test_smo_is_optimal():
    x, y = rng.normal(size=(60, 3)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    kernel, limit = L.rbf(x, x, 0.3), np.where(y > 0, 2.0, 1.0)
    alpha, bias = L.smo(kernel, y, limit)
    assert (alpha >= -1e-12).all() and (alpha <= limit + 1e-12).all() and abs(alpha @ y) < 1e-9
    margin = y * (kernel @ (alpha * y) + bias)
    assert (margin[alpha < 1e-9] > 1 - 2e-3).all() and (margin[alpha > limit - 1e-9] < 1 + 2e-3).all()
    assert np.abs(margin[(alpha > 1e-9) & (alpha < limit - 1e-9)] - 1).max() < 2e-3


def test_kernel_rows_are_made_again_when_there_is_no_room():
    x, y = rng.normal(size=(80, 3)), np.where(rng.random(80) < 0.4, 1.0, -1.0)
    rows = L.KernelRows(x, 0.3, limit=1)
    assert rows.room == 2 and np.array([rows[i] for i in range(80)]) == pytest.approx(L.rbf(x, x, 0.3)) and len(rows.rows) == 2
    alpha, bias = L.smo(L.KernelRows(x, 0.3, limit=1), y, np.full(80, 2.0))
    want, other = L.smo(L.rbf(x, x, 0.3), y, np.full(80, 2.0))
    assert alpha == pytest.approx(want, abs=1e-6) and bias == pytest.approx(other, abs=1e-6)
    with pytest.raises(RuntimeError, match="optimal"):
        L.smo(L.rbf(x, x, 0.3), y, np.full(80, 2.0), steps=3)


def test_svm(blobs):
    x, y = blobs
    model = L.fit_svm(x[:240], y[:240], probability=True)
    assert (model.predict(x[240:]) == y[240:]).mean() > 0.9
    p = model.predict_proba(x[240:])
    assert p.sum(axis=1) == pytest.approx(1) and (np.array(model.classes)[p.argmax(axis=1)] == y[240:]).mean() > 0.9
    again = L.load_model(L.dump_model(model))
    assert (again.predict_proba(x) == model.predict_proba(x)).all() and again.classes == model.classes
    with pytest.raises(ValueError):
        L.fit_svm(x[:100], y[:100]).predict_proba(x)


def test_coupling_recovers_consistent_probabilities():
    p = rng.dirichlet(np.ones(5), 7)
    r = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    assert L.couple(r) == pytest.approx(p)


def test_platt_is_monotone():
    s = rng.normal(size=300)
    a, b = L.platt(s, np.where(s + rng.normal(0, 0.5, 300) > 0, 1.0, -1.0))
    assert a < 0 and abs(b) < 1


def test_mlp(blobs):
    x, y = blobs
    model = L.fit_mlp(x[:240], y[:240], (32, 16), epochs=100)
    assert (model.predict(x[240:]) == y[240:]).mean() > 0.9
    same = L.fit_mlp(x[:240], y[:240], (32, 16), epochs=100)
    assert (same.predict_proba(x) == model.predict_proba(x)).all()


def test_mlp_gradients():
    layers = [(rng.normal(size=(4, 5)), rng.normal(size=5)), (rng.normal(size=(5, 3)), rng.normal(size=3))]
    x, target = rng.normal(size=(6, 4)), np.eye(3)[rng.integers(0, 3, 6)]
    _, grads = L.mlp_gradients(x, target, layers, 0.1)
    for k, (w, _) in enumerate(layers):
        for at in [(0, 0), (2, 1)]:
            old = w[at]
            values = []
            for step in (1e-6, -1e-6):
                w[at] = old + step
                values.append(L.mlp_gradients(x, target, layers, 0.1)[0])
            w[at] = old
            assert grads[k][0][at] == pytest.approx((values[0] - values[1]) / 2e-6, rel=1e-4, abs=1e-7)


@pytest.fixture(scope="module")
def points(spark):
    x = rng.normal(size=(60, 4))
    label = ["big"] * 40 + ["mid"] * 12 + ["low"] * 8
    x[40:52] += 6
    x[52:] -= 6
    x[0] = x[52] + 0.01  # a planted outlier of the big class
    return x, spark.createDataFrame([(i, label[i], x[i].tolist()) for i in range(60)], "id long, label string, features array<double>").repartition(3)


def test_neighbours(points):
    x, df = points
    label = np.array(["big"] * 40 + ["mid"] * 12 + ["low"] * 8)
    d = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    np.fill_diagonal(d, np.inf)
    for same, block in ((True, 7), (False, 1000)):
        got = {}
        for r in balancing.nearest(df, 3, same, block).collect():
            got.setdefault(r["id"], {})[r["rank"]] = r["nn_id"]
        for i in range(60):
            allowed = np.flatnonzero((label == label[i]) | (not same))
            want = sorted((j for j in allowed.tolist() if j != i), key=lambda j: (d[i, j], j))[:3]
            assert [got[i][k] for k in (1, 2, 3)] == want


def test_oversampling(points):
    x, df = points
    new = balancing.smote(df, 3).collect()
    assert {k: sum(r["label"] == k for r in new) for k in ("big", "mid", "low")} == {"big": 0, "mid": 28, "low": 32}
    for r in new:
        a, b = x[r["base_id"]], x[r["nn_id"]]
        assert r["features"] == pytest.approx((a + r["u"] * (b - a)).tolist()) and 0 <= r["u"] < 1
        assert (r["base_id"] >= 52) == (r["nn_id"] >= 52) == (r["label"] == "low")
    with pytest.raises(ValueError, match="'low' has 8 rows"):
        balancing.smote(df, 8)


def test_cleaning(points):
    _, df = points
    gone = {r["id"] for r in balancing.vote_keeps(df, 3).collect() if not r["keep"]}
    assert gone == {0}
    both = balancing.balance(df, "smoteenn", 3, 3)
    # after oversampling all classes are equal, and the first of them isn't cleaned
    assert "0" in {r["id"] for r in both.collect()} and both.count() == 120
    assert balancing.balance(df, "none").count() == 60
    with pytest.raises(ValueError):
        balancing.balance(df, "other")


def test_metrics(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")]
    df = spark.createDataFrame(pairs, "truth string, pred string")
    got = metrics.summary(df).first()
    precision, recall = [5 / 6, 3 / 5, 0], [5 / 7, 1, 0]
    f1 = [10 / 13, 6 / 8, 0]
    assert got["accuracy"] == pytest.approx(8 / 11) and got["balanced_accuracy"] == pytest.approx(np.mean(recall))
    assert (got["precision_macro"], got["recall_macro"], got["f1_macro"]) == pytest.approx((np.mean(precision), np.mean(recall), np.mean(f1)))
    cells = {(r["truth"], r["pred"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells["a", "b"] == 2 and cells["c", "c"] == 0
    rows = {r["row"]: r for r in metrics.report(df).collect()}
    assert rows["weighted avg"]["f1"] == pytest.approx(np.average(f1, weights=[7, 3, 1])) and rows["accuracy"]["support"] == 11


def test_scaling(points):
    x, df = points
    z = np.array([r["features"] for r in scaling.scaled(df, scaling.feature_stats(df)).orderBy("id").collect()])
    assert z == pytest.approx(L.Scaler.fit(x)(x))
    assert scaling.gamma_scale(df).first()["gamma"] == pytest.approx(1 / (4 * x.var()))


def brute_search(truth, probs, labels, minority, floor, grid):
    def f1(c, pred):
        tp, n = ((pred == c) & (truth == c)).sum(), (pred == c).sum() + (truth == c).sum()
        return 2 * tp / n if n else 0.0

    best = dict.fromkeys(labels, 0.5)
    for target in [c for c in labels if c in minority] + [c for c in labels if c not in minority]:
        scores = []
        for thr in grid:
            pred = L.limited_choice(probs, labels, best | {target: thr})
            own = truth == target
            recall = (pred[own] == target).mean() if own.any() else 0.0
            scores.append(round(np.mean([f1(c, pred) for c in labels]) - (max(0, floor - recall) if target in minority else 0), 12))
        best[target] = grid[int(np.argmax(scores))]
    return best


def test_threshold_search(spark):
    labels, truth = ["a", "b", "c"], rng.choice(["a", "b", "c"], 80, p=[0.6, 0.3, 0.1])
    probs = rng.dirichlet([3, 2, 1], 80)
    df = spark.createDataFrame([(i, str(t), p.tolist()) for i, (t, p) in enumerate(zip(truth, probs, strict=True))], "id long, truth string, probs array<double>")
    got = thresholds.search(df, labels, ("c",), 0.4)
    assert got == pytest.approx(brute_search(truth, probs, labels, ("c",), 0.4, thresholds.grid()))


def test_two_stage_composition(spark):
    one = spark.createDataFrame([(1, "nv", 0.7), (1, "non_nv", 0.3), (2, "nv", 0.0), (2, "non_nv", 0.0)], "id long, cls string, p double")
    two = spark.createDataFrame([(i, c, p) for i in (1, 2) for c, p in (("mel", 0.8), ("df", 0.2))], "id long, cls string, p double")
    got = {(r["id"], r["cls"]): r["p"] for r in thresholds.compose_two_stages(one, two, ["mel", "nv"]).collect()}
    assert got == pytest.approx({(1, "nv"): 0.7 / 0.94, (1, "mel"): 0.24 / 0.94, (2, "nv"): 0, (2, "mel"): 0})
