"""What exists twice, as column expressions (which SQL checks) and as array kernels (which renders run), gives the same pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulsa.functions import colour as C
from emulsa.kernels import primitives as P
from emulsa.kernels import stages as K
from emulsa.operators import meter as M
from emulsa.operators import neighbour as N
from emulsa.operators import points
from emulsa.params.catalog import DEFAULTS

H, W = 23, 31
SCENE = np.random.default_rng(11).random((3, H, W), np.float32)
SCENE[:, 3:6] = SCENE[0, 3:6]  # greys
SCENE[:, 8] = 0.0
SCENE[:, 9] = 1.0
AT = K.Place(0, 0, H, W)
OFF = DEFAULTS | {k: 0.0 for k in ("grade_recover", "grade_clarity", "lut_amount", "highlight_priority") if k in DEFAULTS}


def rgb():
    return tuple(map(F.col, "rgb"))


@pytest.fixture(scope="module")
def scene(spark):
    rows = [("a", y, x, *map(float, SCENE[:, y, x])) for y in range(H) for x in range(W)]
    return spark.createDataFrame(rows, "image_id string, y int, x int, r double, g double, b double").persist()


def planes(df, columns="rgb", h=H, w=W):
    out = np.full((len(columns), h, w), np.nan)
    for r in df.select("y", "x", *columns).collect():
        out[:, r[0], r[1]] = r[2:]
    return out


def each(columns):
    return lambda d: d.select("y", "x", *[e.alias(c) for c, e in zip("rgb", columns, strict=True)])


GRADES = {
    "white balance": {"grade_temp": 0.4, "grade_tint": -0.3}, "exposure": {"grade_exposure": 0.7}, "shadows and highlights": {"grade_shadows": 0.5, "grade_highlights": -0.6}, "the other way": {"grade_shadows": -0.4, "grade_highlights": 0.3},
    "contrast and black point": {"grade_contrast": 0.3, "grade_black_point": 0.05}, "vibrance": {"grade_vibrance": 0.6}, "saturation": {"grade_saturation": -0.4},
    "all": {"grade_temp": -0.2, "grade_exposure": -0.4, "grade_shadows": 0.3, "grade_contrast": -0.2, "grade_black_point": 0.02, "grade_vibrance": -0.5, "grade_saturation": 0.3},
}
TONES = {"contrast": {"contrast": 0.4}, "curve": {"toe": 0.5, "shoulder": 0.6, "contrast": 0.2}, "warmth": {"highlight_warmth": 0.5, "shadow_warmth": -0.4}, "all": {"contrast": -0.3, "toe": 0.2, "shoulder": 0.3, "highlight_warmth": -0.2}, "none": {}}


@pytest.mark.parametrize("name", GRADES)
def test_grade(scene, name):
    p = OFF | GRADES[name]
    assert np.abs(planes(points.grade(scene, p)) - K.grade(SCENE, p, AT)).max() < 2e-5


@pytest.mark.parametrize("name", TONES)
def test_tone(scene, name):
    p = OFF | TONES[name]
    assert np.abs(planes(points.tone(scene, p)) - K.tone(SCENE, p)).max() < 2e-5


def test_transfer_curves_and_steps(scene):
    lin, disp = planes(each([C.linear(c) for c in rgb()])(scene)), planes(each([C.display(c) for c in rgb()])(scene))
    assert np.abs(lin - P.linear(SCENE)).max() < 2e-6 and np.abs(disp - P.display(SCENE)).max() < 2e-6
    assert np.abs(planes(each([C.smoothstep(0.2, 0.7, c) for c in rgb()])(scene)) - P.ss(0.2, 0.7, SCENE)).max() < 2e-6
    assert np.abs(planes(each([C.smootherstep(0.2, 0.7, c) for c in rgb()])(scene)) - P.sss(0.2, 0.7, SCENE)).max() < 2e-6


def test_hues(scene):
    assert np.abs(planes(each(C.rotate_hue(rgb(), F.lit(33.0)))(scene)) - P.rotate_hue(SCENE, np.full((H, W), 33.0, np.float32))).max() < 2e-5
    h, s = P.hue_sat(SCENE)
    got = planes(scene.select("y", "x", C.hue(*rgb()).alias("h"), C.saturation(*rgb()).alias("s")), "hs")
    turn = np.abs(got[0] - h) % 360
    assert np.minimum(turn, 360 - turn).max() < 2e-2 and np.abs(got[1] - s).max() < 1e-5


@pytest.mark.parametrize("mode", range(6))
def test_blends(scene, mode):
    name = ("Add", "Overlay", "Soft Light", "Hard Light", "Multiply", "Screen")[mode]
    layer = F.col("g") * 2 - 1
    got = planes(each([C.blend_delta(name, c, layer) for c in rgb()])(scene))
    assert np.abs(got - K.blend_delta(SCENE, np.repeat(SCENE[1:2] * 2 - 1, 3, axis=0), mode)).max() < 2e-6


def test_source_masks(scene):
    got = planes(scene.select("y", "x", *[c.alias(n) for c, n in zip(C.source_masks(rgb(), 0.4), "abcd", strict=True)]), "abcd")
    assert np.abs(got - np.array(K.source_masks(SCENE, 0.4))).max() < 2e-6


@pytest.mark.parametrize("sigma", [0.6, 1.7, 4.0])
def test_neighbourhoods(scene, sigma):
    limit = min(H, W) - 1
    assert np.abs(planes(N.blur(scene, list("rgb"), sigma, limit)) - P.blur(SCENE, sigma)).max() < 5e-6
    assert np.abs(planes(N.unsharp(scene, 0.8, sigma, limit)) - (SCENE + (SCENE - P.blur(SCENE, sigma)) * np.float32(0.8))).max() < 2e-5
    assert np.abs(planes(N.linear_blur(scene, sigma, limit)) - P.clamp(P.display(P.blur(P.linear(SCENE), sigma)))).max() < 2e-5
    assert np.abs(planes(N.clarity(scene, 0.5, sigma, limit)) - K.grade(SCENE, OFF | {"grade_clarity": 0.5, "grade_clarity_radius": sigma}, AT)).max() < 2e-5
    for chroma in (0.0, 0.7):
        assert np.abs(planes(N.edge_magnitude(scene, sigma, chroma, limit), ["edge"])[0] - P.edge_magnitude(SCENE, sigma, chroma)).max() < 1e-5


def test_pools(scene):
    y, x = 20, 28
    got = planes(N.box_pool(scene.filter(f"y < {y} and x < {x}"), 4), h=y // 4, w=x // 4)
    assert np.abs(got - P.box_pool(SCENE[:, :y, :x], 4)).max() < 2e-6


def test_normalize(scene):
    told = M.meter(scene.unionByName(scene.withColumn("y", F.col("y") + H)))
    m = {k: v for k, v in told.first().asDict().items() if k != "image_id"}
    assert set(m) == {"norm_ev", "norm_gain_r", "norm_gain_g", "norm_gain_b", "norm_toe", "norm_white"} and m["norm_ev"] != 0
    for priority in (0.0, 0.4):
        p = OFF | {"normalize": 1.0, "highlight_priority": priority}
        assert np.abs(planes(M.normalize(scene, told, priority)) - K.normalize(SCENE, p, m)).max() < 3e-5


def test_luts(spark, scene):
    n = 5
    table = np.random.default_rng(2).random(n**3 * 3).astype(np.float32)
    lut = {"size": n, "dmin": [0.0, 0.1, 0.0], "dmax": [1.0, 1.0, 0.9], "table": table}
    got = planes(each(C.lut_trilinear(rgb(), F.array(*[F.lit(float(v)) for v in table]), n, lut["dmin"], lut["dmax"]))(scene))
    assert np.abs(got - K.apply_lut(SCENE, lut)).max() < 5e-6
