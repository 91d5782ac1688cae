"""Lines in blocks, decimated blurs and noise columns, against plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulsa.functions import noise as X
from emulsa.kernels import noise as K
from emulsa.kernels.primitives import blur as exact
from emulsa.kernels.stages import scatter_offsets
from emulsa.operators import neighbour as N


def frame(spark, h, w, f="(y * 31 + x * 17) % 23 / 22.0"):
    return spark.range(h * w).selectExpr("'a' as image_id", f"cast(id div {w} as int) as y", f"cast(id % {w} as int) as x").withColumn("r", F.expr(f)).withColumn("g", F.col("x") / float(w)).withColumn("b", F.lit(0.5))


def grid(df, c, h, w):
    out = np.zeros((h, w))
    for r in df.select("y", "x", c).collect():
        out[r.y, r.x] = r[c]
    return out


@pytest.mark.parametrize("block", [16, 40, 1024])
def test_blocks_change_nothing(spark, monkeypatch, block):
    """Lines of 130 in blocks of 16 (shorter than the reach, which then is the length), 40, and whole."""
    monkeypatch.setattr(N, "BLOCK", block)
    h, w = 7, 130
    df = frame(spark, h, w)
    x = grid(df, "r", h, w)
    r = 15  # the kernel is wider than the frame is high, so the border reflects more than once
    got = grid(N.blur(df, ["r"], 5.0), "r", h, w)
    k = np.array([wt for _, wt in N.taps(5.0)])
    pad = np.pad(x, r, mode="reflect")
    rows = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, pad)
    assert np.abs(got - np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, rows)).max() < 1e-12
    held = np.pad(x, 2, mode="constant", constant_values=-1)
    want = np.max([held[2 + a : 2 + a + h, 2 + c : 2 + c + w] for a in range(-2, 3) for c in range(-2, 3)], axis=0)
    assert np.array_equal(grid(N.dilate(df, ["r"], 2), "r", h, w), want)
    p = np.pad(x, 1, mode="edge")
    g = N.gradient(df, "r")
    assert np.abs(grid(g, "gx", h, w) - (p[1:-1, 2:] - p[1:-1, :-2]) / 2).max() < 1e-12 and np.abs(grid(g, "gy", h, w) - (p[2:, 1:-1] - p[:-2, 1:-1]) / 2).max() < 1e-12


def test_rows_are_bounded(spark):
    """A line of 200,000 pixels: no row holds more than a block and its reach."""
    df = frame(spark, 2, 200_000)
    rows, n = N._blocks(df, "x", ["image_id", "y"], ["r"], 30)
    sizes = rows.select(F.size("line").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert n == N.BLOCK and sizes[0] == n + 60 and sizes[1] == 2 * -(-200_000 // n)
    assert N.blur(df, ["r"], 2.0).count() == 400_000


def test_gaps_between_images(spark):
    one, two = frame(spark, 5, 40), frame(spark, 9, 33, "x / 33.0").withColumn("image_id", F.lit("b"))
    both = N.blur(one.union(two), ["r"], 1.5)
    for df, name, h, w in ((one, "a", 5, 40), (two, "b", 9, 33)):
        assert np.array_equal(grid(both.filter(F.col("image_id") == name), "r", h, w), grid(N.blur(df, ["r"], 1.5), "r", h, w))


def test_cubic_weights():
    for k in (2, 5, 64):
        for j, row in enumerate(N.cubic_weights(k)):
            assert sum(w for _, w in row) == pytest.approx(1) and sum(c * w for c, w in row) == pytest.approx((j + 0.5) / k - 0.5, abs=0.08)


@pytest.mark.parametrize(("sigma", "size", "near"), [(36.0, 240, 1e-3), (80.0, 500, 1e-3)])
def test_decimated_is_near_exact(spark, sigma, size, near):
    df = frame(spark, size, size, f"case when x > {size // 2} and y > {size // 2} then 0.7 else 0.1 end + 0.05 * ((x * 7 + y * 13) % 11) / 10.0")
    got = grid(N.decimated_blur(df, ["r"], sigma), "r", size, size)
    want = exact(grid(df, "r", size, size)[None].astype(np.float32), sigma)[0]
    assert np.abs(got - want).max() < near


def test_decimated_plan_does_not_grow_with_sigma(spark):
    df = frame(spark, 20, 20)
    taps = lambda s: len(N.taps((s * s - (min(64, s // 16) ** 2 - 1) / 12) ** 0.5 / min(64, s // 16)))
    assert max(taps(s) for s in (48.0, 80.0, 300.0, 1000.0)) <= 105
    plan = N.decimated_blur(df, ["r"], 300.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "BatchEvalPython" not in plan and "MapInArrow" not in plan
    assert N.decimated_blur(df, ["r"], 20.0).columns == df.columns and N.decimated_blur(df, ["r"], 0.01) is df


def test_many_taps_are_one_expression(spark, monkeypatch):
    """The plan of a long blur is no longer than that of a short one; values are those of the unrolled sums, over several blocks and over lines shorter than the reach."""
    df = frame(spark, 3, 2_300, "((x * 7 + y * 13) % 11) / 10.0").withColumn("z", F.col("x") * 2)
    plan = N.decimated_blur(df, ["r"], 300.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("pmod(") <= 4
    got = N.blur(df, ["r"], 12.0)
    monkeypatch.setattr(N, "UNROLLED", 1_000)
    want = N.blur(df, ["r"], 12.0)
    assert got.columns == want.columns == df.columns and got.dtypes == want.dtypes
    both = got.join(want.withColumnRenamed("r", "s").withColumnRenamed("z", "t"), ["image_id", "y", "x"], "full")
    assert both.select(F.count("*"), F.count("r"), F.count("s"), F.sum((F.col("z") != F.col("t")).cast("int")), F.max(F.abs(F.col("r") - F.col("s"))) < 1e-12).first() == (6_900, 6_900, 6_900, 0, True)


def test_parts_of_a_frame_get_the_same_cells(spark):
    """A part that begins on no multiple of the cell's side, well within the frame."""
    df = frame(spark, 12, 1_000, "sin(x / 40.0) / 2 + 0.5")
    whole = N.decimated_blur(df, ["r"], 40.0)
    part = N.decimated_blur(df.filter("x >= 301 and x < 901"), ["r"], 40.0)
    both = whole.filter("x between 560 and 640").join(part.withColumnRenamed("r", "s"), ["y", "x"]).select(F.max(F.abs(F.col("r") - F.col("s")))).first()[0]
    assert both < 2e-3


def test_noise_is_that_of_the_kernels(spark):
    df = spark.range(400).selectExpr("cast(id div 20 - 7 as int) as y", "cast(id % 20 - 5 as int) as x")
    at = lambda d, c: np.array([r[c] for r in d.orderBy("y", "x").collect()]).reshape(20, 20)
    assert np.array_equal(at(X.with_noise(df, "lattice", "v", 1234, field=2), "v"), K.lattice(-7, -5, 20, 20, 1234, 3)[2])
    assert np.array_equal(at(X.with_noise(df, "cell", "v", 77, 3.2), "v"), K.cell_noise(-7, -5, 20, 20, 3.2, 77)[0])
    assert np.abs(at(X.with_noise(df, "value", "v", 99, 3.2), "v") - K.value_noise(-7, -5, 20, 20, 3.2, 99)[0]).max() < 1e-6
    fields, want = X.with_fbm(df, ["a", "b"], 5, 1.7, 3, 0.6), K.fbm(-7, -5, 20, 20, 1.7, 5, 2, 3, 0.6)
    assert all(np.abs(at(fields, c) - want[k]).max() < 2e-6 for k, c in enumerate("ab"))
    plan = fields._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "MapInArrow" not in plan
    for pattern in range(9):
        got = X.with_scatter(df, 0.7, 6.0, 1.5, 9, 0.5, pattern)
        pick, far, gate = K.cell_noise(-7, -5, 20, 20, 1.5, 9 + 3301, 3)
        dx, dy = scatter_offsets(pick, far, 6.0, 0.5, pattern)
        assert np.array_equal(at(got, "dy"), np.where(gate < 0.7, dy, 0)) and np.array_equal(at(got, "dx"), np.where(gate < 0.7, dx, 0))


def test_arithmetic_is_checked_again(spark):
    was = spark.conf.get(X.CHECKED)
    X.with_noise(spark.range(3).selectExpr("id as y", "id as x"), "lattice", "v", 3).collect()
    assert spark.conf.get(X.CHECKED) == was
    own = spark.range(3).selectExpr("id as y", "id as x", "1 as _n0", "2 as _N1")
    assert X.with_noise(own, "value", "v", 3, 2.0).columns == ["y", "x", "_n0", "_N1", "v"]
