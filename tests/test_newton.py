"""The penalised-intercept logistic fit against a dense solver."""

import numpy as np
import pytest

from riskrank.operators import newton


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.random((120, 30)) * (rng.random((120, 30)) < 0.2)
    x[5] = 0.0
    y = (x[:, 0] * 4 + x[:, 1] * 3 + rng.normal(size=120) * 0.4 > 0.9).astype(int)
    rows = [(i, int(y[i]), np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist()) for i in range(120)]
    return x, y, spark.createDataFrame(rows, "id long, fraudulent int, _i array<int>, _v array<double>").repartition(5)


def dense_newton(x, y, c, weight):
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        grad = w + c * x.T @ (weight * (p - y))
        w = w - np.linalg.solve(np.eye(len(w)) + c * (x.T * (weight * p * (1 - p))) @ x, grad)
    return w


@pytest.mark.parametrize("balanced, c", [(True, 1.0), (False, 0.1), (True, 30.0)])
def test_the_optimum_is_that_of_a_dense_solver(data, balanced, c):
    x, y, rows = data
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    want = dense_newton(x, y, c, weight)
    m = newton.fit(rows, 30, c, balanced=balanced)
    assert np.abs(np.append(m.coefficients, m.intercept) - want).max() < 1e-6
    assert m.gradient_norm <= 1e-8 * m.start_norm and m.iterations < 30
    got = {r["id"]: r["y_proba"] for r in m.scores(rows).collect()}
    p = 1 / (1 + np.exp(-(x @ want[:-1] + want[-1])))
    assert len(got) == 120 and all(abs(got[i] - p[i]) < 1e-6 for i in got)


def test_the_answer_does_not_depend_on_partitions_and_few_steps_stop(data):
    _, _, rows = data
    a, b = newton.fit(rows, 30), newton.fit(rows.coalesce(1), 30)
    assert np.abs(a.coefficients - b.coefficients).max() < 1e-7
    assert newton.fit(rows, 30, max_iter=1).iterations == 1
    zero = newton.fit(rows.select("id", "fraudulent", *[rows[c] for c in ("_i", "_v")]).where("size(_i) = 0 OR fraudulent = 1"), 30)
    assert np.isfinite(zero.coefficients).all()
