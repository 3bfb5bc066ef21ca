import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from rallyframe.llm import whitening
from rallyframe.llm.common import table
from rallyframe.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, components=4):
    """By exact fractions: n, deviation by row, covariance of whole numbers."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in usable), default=0)
    whole = [(i, tuple(math.floor(256 * float(c)) for c in v) + (0,) * (width - len(v))) for i, v in usable]
    once = sorted({x for _, x in whole})
    n, sums = len(once), [sum(c) for c in zip(*once, strict=True)]
    centred = [[Fraction(c) - Fraction(s, n) for c, s in zip(x, sums, strict=True)] for x in once]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(width)] for i in range(width)])
    deviations = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), [float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)]) for i, x in whole]
    return n, v, deviations


def check(df, rows, components=4):
    n, v, deviations = plain(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    got = df.collect()
    assert len(got) == len(deviations) * components
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.deviation) for r in got if r.component == 1) == sorted((i is not None, i or 0, d) for i, d, _ in deviations)
    for k in range(components):
        mine = sorted((r.deviation, abs(r.whitened)) for r in got if r.component == k + 1)
        want = sorted((d, abs(np.dot(c, vectors[:, k])) / math.sqrt(values[k])) for _, d, c in deviations)
        assert np.allclose([x for _, x in mine], [x for _, x in want], rtol=1e-6, atol=1e-7)
        signed = [r.whitened for r in sorted((r for r in got if r.component == k + 1), key=lambda r: r.vec_id or 0)]
        theirs = [np.dot(c, vectors[:, k]) for _, _, c in sorted(deviations, key=lambda x: x[0] or 0)]
        assert abs(np.dot(signed, theirs)) == pytest.approx(np.linalg.norm(signed) * np.linalg.norm(theirs))
        (explained,) = {r.explained for r in got if r.component == k + 1}
        assert explained == pytest.approx(values[k] / np.trace(v), rel=1e-9)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9


def test_query_against_fractions(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").where("vec_id < 60").collect()]
    check(whitening.whiten(table(spark, sf, "embeddings").where("vec_id < 60")), rows)


def test_whole_table_is_whitened(spark, sf):
    whole = table(spark, sf, "embeddings")
    got = QUERIES["op11_embedding_whitening"](spark, sf)
    n = whole.count()
    x = np.floor(256 * np.array([r.embedding for r in whole.orderBy("vec_id").collect()], float))
    x = np.unique(x, axis=0)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    rows = got.collect()
    assert len(rows) == 4 * n and {r.n for r in rows} == {len(x)} and rows[0].identity_error < 1e-9
    assert [min(r.explained for r in rows if r.component == k) for k in (1, 2, 3, 4)] == pytest.approx(values[:4] / values.sum())


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(3, [0.5] * 6)] * 5 + [(None, rng.normal(size=6).tolist()), (50, []), (51, [1.0, -0.0])]
    rows += [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (62, [float("nan")] * 6), (63, [float("inf")] + [0.0] * 5), (64, [-float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("x", "n", "deviation", "whitened", "place", "component", "d0", "explained")})
    check(whitening.whiten(df), rows)


@pytest.mark.parametrize("scale", [1e3, 1e9, 1e14])
def test_sums_stay_exact_for_large_entries(spark, scale):
    """A common offset that rounds away in plain sums of squares, and numbers beyond 64 bits."""
    rng = np.random.default_rng(2)
    rows = [(i, (scale + rng.normal(size=5) * [9, 7, 5, 3, 1]).tolist()) for i in range(64)]
    df = spark.createDataFrame(rows, SCHEMA)
    n, v, deviations = plain(rows)
    model = whitening.fit(df)
    assert model.n == n and np.allclose(model.values, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-9)
    got = {r.vec_id: r.deviation for r in whitening.apply(df, model, ["vec_id"]).collect()}
    assert got == {i: d if d < 1 << 63 else None for i, d, _ in deviations}


def test_kept_columns_may_have_any_name(spark):
    rows = [(i, [float(i), float(i * i % 7)], f"k{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "kept_0 long, x array<double>, vector string")
    model = whitening.fit(df, "x")
    got = {r.kept_0: (r.vector, r.x, len(r.whitened)) for r in whitening.apply(df, model, ["vector", "x", "kept_0"], "x").collect()}
    assert got == {i: (k, v, 2) for i, v, k in rows}


def test_squares_of_any_size():
    rng = np.random.default_rng(3)
    for bits in (3, 20, 30, 45, 60):
        z = rng.integers(-(1 << bits), 1 << bits, size=(50, 4))
        want = [sum(int(x) ** 2 for x in c) for c in z.T]
        assert list(whitening.squares(z)) == want and list(whitening.squares(z.astype(object))) == want
        y = z[:, :3]
        assert list(whitening.pair_squares(y)) == [sum(int(x) ** 2 for x in c) for c in [*y.T, y[:, 0] + y[:, 1], y[:, 0] + y[:, 2], y[:, 1] + y[:, 2]]]


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert df.count() == 0 and [f.name for f in df.schema] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], SCHEMA))
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9))) for r in two.collect()) == [(1, 1, 1.0), (2, 1, 1.0)]
