import math

import numpy as np
import pytest

from gatelens.llm.whitening import eigenvectors, refined, whiten

SCHEMA = "vec_id long, component string, embedding array<float>, label int"


def brute(rows, components=16):
    """Exact integers, and numpy's own double-precision eigenvectors."""
    good = [(i, v) for i, _, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (i, _), v in zip(good, x, strict=True):
        scaled = [n * c - s for c, s in zip(v, sums, strict=True)]
        white = (np.array(scaled) / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
        for k in range(min(components, len(sums))):
            out.append((i, k + 1, n, sum(c * c for c in scaled), white[k], values[k] / np.trace(cov)))
    return out, vectors


def compared(df, rows):
    got = sorted(df.collect(), key=lambda r: (-1 if r.vec_id is None else r.vec_id, r.deviation, r.component))
    want = sorted(brute(rows)[0], key=lambda r: (-1 if r[0] is None else r[0], r[3], r[1]))
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    assert all(int(r.deviation_exact) == r.deviation for r in got)
    white = {}
    for r, w in zip(got, want, strict=True):
        white.setdefault(r.component, []).append((r.whitened, w[4]))
        assert r.explained == pytest.approx(w[5], rel=1e-9)
        assert r.identity_error < 1e-10
    for pairs in white.values():
        a, b = np.array(pairs).T
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)  # one sign for all rows


def test_whitening_against_brute_force(spark):
    draw = np.random.default_rng(3)
    scale = np.linspace(0.2, 3, 20)
    made = (draw.normal(size=(400, 20)) * scale).astype(np.float32).tolist()
    rows = [(i, "x", v, 1) for i, v in enumerate(made)]
    rows += [(1000 + i, "x", made[0], None) for i in range(300)]  # a hot vector
    rows += [(5, "x", made[5], 1), (None, None, made[6], 1)]
    rows += [(7000, "x", None, 1), (7001, "x", made[1][:-1] + [None], 1)]
    rows += [(7002, "x", made[1][:-1] + [float("nan")], 1), (7003, "x", made[1][:-1] + [float("inf")], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    compared(whiten(df), rows)
    # lists of another length share no dimensions
    other = [(8000, "x", [1.0, 2.0], 1), (8001, "x", [], 1)]
    assert whiten(df.union(spark.createDataFrame(other, SCHEMA))).where("vec_id >= 7000").count() == 0


def test_whitening_of_little(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, "x", [], 1), (2, "x", None, 1)], SCHEMA)).count() == 0
    one = whiten(spark.createDataFrame([(1, "x", [1.0, 2.0], 1)] * 2, SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (1, 1, 0, None, None, None),
        (2, 1, 0, None, None, None),
    ] * 2
    # one dimension is constant
    flat = whiten(spark.createDataFrame([(i, "x", [float(i), 4.0], 1) for i in range(5)], SCHEMA)).collect()
    assert {r.whitened for r in flat if r.component == 2} == {None}
    assert {round(r.whitened, 6) for r in flat if r.component == 1} == {round(v / math.sqrt(2), 6) for v in range(-2, 3)}
    assert whiten(spark.createDataFrame([(1, "x", [1.0] * 40, 1)], SCHEMA)).count() == 16


def test_whitening_of_large_entries(spark):
    rows = [(i, "x", [float(i) * 1e9, float(i % 7), -1e12 + 65536.0 * i], 1) for i in range(50)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {r[0]: r[3] for r in brute(rows)[0]}
    for r in got:
        assert int(r.deviation_exact) == want[r.vec_id]
        assert r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None)
    assert any(r.deviation is None for r in got)
    refused = spark.createDataFrame([(1, "x", [1e30], 1)], SCHEMA)
    with pytest.raises(Exception, match="is beyond"):
        whiten(refused).count()


@pytest.mark.parametrize("gap", [0.0, 1e-12, 1e-9, 1e-6, 1e-3])
def test_clustered_eigenvalues(gap):
    draw = np.random.default_rng(7)
    size = 32
    turn = np.linalg.qr(draw.normal(size=(size, size)))[0]
    wanted = np.sort(draw.uniform(1, 3, size))[::-1]
    wanted[4:9] = wanted[4] - gap * np.arange(5)
    wanted[20:22] = wanted[20] - gap * np.arange(2)
    wanted = np.sort(wanted)[::-1]
    a = (turn * wanted) @ turn.T
    a = (a + a.T) / 2
    values, x = eigenvectors(a)
    assert np.abs(values - wanted).max() < 1e-13
    assert np.abs(a @ x - x * values).max() < 1e-13
    assert np.abs(x.T @ x - np.eye(size)).max() < 1e-10


def test_a_correction_doubles_the_digits():
    draw = np.random.default_rng(8)
    a = np.diag(np.arange(1.0, 11)) + 0.1 * (lambda m: m + m.T)(draw.normal(size=(10, 10)))
    x = np.linalg.eigh(a)[1]
    for size in (1e-2, 1e-4):
        rough = x + size * draw.normal(size=x.shape)
        better, _, _ = refined(a, rough)
        assert np.abs(better - x * np.sign((better * x).sum(0))).max() < 300 * size**2
