"""Kept pictures at section boundaries: which renders read them, that they are never stale, and what they may take."""

import numpy as np
import pytest

from emulsa.kernels.stages import BOUNDARIES
from emulsa.operators import sections as S
from emulsa.operators.render import FRAME, planes_of, render
from emulsa.params.catalog import DEFAULTS, PARAMS
from emulsa.plans.planner import plan, tile_grid

H, W = 96, 120
BASE = {"halation_radius": 6, "grade_exposure": 0.3, "intensity": 40, "dust": 10, "light_leak": 2, "scratches": 4, "hair": 3, "global_intensity": 30, "sharpen": 0.5, "pre_sharpen": 0.4, "edge_soften": 0.4, "edge_jitter": 1, "scatter": 0.4, "aa_strength": 0.5, "brightness": 0.1}
#: A parameter of every section, moved.
MOVES = {"Normalize": ("highlight_priority", 0.8), "Colour Grading": ("grade_temp", 0.4), "Pre Blur": ("pre_blur", 1.5), "Pre Sharpen": ("pre_sharpen", 0.9), "Grain Structure": ("intensity", 70), "Edge Destruction": ("edge_soften", 0.9),
         "Anti Aliasing": ("aa_strength", 1.5), "Halation": ("halation", 0.8), "Tone Response": ("brightness", 0.5), "Film Texture": ("dust", 60), "Global Grain": ("global_intensity", 70), "Sharpening": ("sharpen", 1.0), "Output": ("master_opacity", 0.6)}
NORM = [("a", 0.4, 1.1, 1.0, 0.9, 0.1, 1.3)]


def made(values, tile=48):
    return plan(DEFAULTS | BASE | values, 1, tile=tile)


@pytest.fixture(scope="module")
def frames(spark):
    y, x = np.mgrid[0:H, 0:W]
    planes = np.stack([x / W, y / H, (np.sin(x / 9) + 1) / 2]).astype("<f4")
    planes[:, 30:60, 40:80] = 0.97
    return spark.createDataFrame([("a", H, W, planes.tobytes())], FRAME).persist()


@pytest.fixture(scope="module")
def meter(spark):
    return spark.createDataFrame(NORM, "image_id string, norm_ev double, norm_gain_r double, norm_gain_g double, norm_gain_b double, norm_toe double, norm_white double")


def picture(df):
    r = df.first()
    return planes_of(bytes(r.planes), r.h, r.w)


@pytest.fixture()
def store(spark, tmp_path):
    return S.Sections(spark, f"file://{tmp_path}")


def test_every_section_has_a_move():
    assert set(MOVES) == {p.section for p in PARAMS}


def test_warm_equals_cold(spark, frames, meter, tmp_path):
    """A store that has seen other settings and one that has seen nothing, for a move in every section."""
    warm = S.Sections(spark, f"file://{tmp_path}/warm")
    source = warm.open(frames, meter)
    first = picture(warm.render(source, made({"normalize": 1})))
    assert np.abs(first - picture(render(frames, made({"normalize": 1}), meter))).max() < 2e-3
    for name, (key, value) in MOVES.items():
        p = made({"normalize": 1, key: value})
        got = picture(warm.render(source, p))
        cold = S.Sections(spark, f"file://{tmp_path}/{key}")
        want = picture(cold.render(cold.open(frames, meter), p))
        assert np.abs(got - want).max() < 1e-6 and np.abs(got - first).max() > 1e-4, name


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_change_below_a_boundary_reads_the_boundary_alone(store, frames):
    source = store.open(frames)
    store.tiles(source, made({}))
    assert len(store.known()) == 2  # nothing is normalised, so there are two boundaries
    by_key = {e["key"]: e["folder"] for e in store.known()}
    for key, value, written, at in (("dust", 50, 0, "Halation"), ("halation", 0.9, 0, "Halation"), ("intensity", 70, 1, None), ("grade_temp", 0.3, 2, None)):
        before = {e["folder"] for e in store.known()}
        p = made({key: value})
        tiles = store.tiles(source, p)
        assert len(store.known()) - len(before) == written, key
        told, read = scans(tiles), {f.split("/")[-2] for f in tiles.inputFiles()}
        assert told.count("MapInArrow") == 1 and "Exchange" not in told and len(read) == 1
        assert not at or read == {by_key[S.hashlib.sha256(f"{source} {S.signature(p, at)}".encode()).hexdigest()]}


def test_signature():
    p = made({})
    for b in BOUNDARIES:
        assert S.signature(p, b) == S.signature(made({"dust": 70, "global_size": 3, "sharpen": 0}), b)
    assert S.signature(p, "Halation") != S.signature(made({"brightness": 0.4}), "Halation")  # read above, by the masks
    assert S.signature(p, "Grain Structure") == S.signature(made({"brightness": 0.4, "intensity": 1}), "Grain Structure")
    assert S.signature(p, "Grain Structure") != S.signature(made({"pre_blur": 2}), "Grain Structure")
    assert S.signature(p, "Halation") != S.signature(made({}, tile=64), "Halation")
    a, b = ({"size": 2, "table": np.full(24, v)} for v in (0.1, 0.2))
    assert S.signature(plan(BASE, 1, lut=a), "Halation") != S.signature(plan(BASE, 1, lut=b), "Halation")


def test_content_is_the_source(store, frames, spark):
    one = store.open(frames)
    assert one == store.open(spark.createDataFrame(frames.collect(), FRAME))
    r = frames.first()
    other = bytearray(r.planes)
    other[5] ^= 1
    assert one != store.open(spark.createDataFrame([("a", r.h, r.w, bytes(other))], FRAME))


def test_least_recently_used_go(store, frames):
    source = store.open(frames)
    store.tiles(source, made({}))
    first = {e["folder"] for e in store.known()}
    store.budget = int(1.05 * sum(e["bytes"] for e in store.known()))
    store.tiles(source, made({"dust": 33}))  # uses the deep one
    picture(store.render(source, made({"intensity": 55})))  # writes another deep one: something has to go
    left = {e["folder"] for e in store.known()}
    assert sum(e["bytes"] for e in store.known()) <= store.budget and left != first and len(left & first) == 1
    assert np.abs(picture(store.render(source, made({}))) - picture(render(frames, made({})))).max() < 2e-3


def test_wider_overlap_is_not_taken_from_narrow_tiles(store, frames):
    source = store.open(frames)
    store.tiles(source, made({}))
    wide = made({"halation_radius": 40})
    assert np.abs(picture(store.render(source, wide)) - picture(render(frames, wide))).max() < 2e-3
    assert len({e["overlap"] for e in store.known()}) == 2


def test_neutral_and_empty(store, frames, spark):
    source = store.open(frames)
    assert np.array_equal(picture(store.render(source, plan(dict.fromkeys(DEFAULTS, 0.0) | {"master_opacity": 0.0}))), picture(frames))
    none = store.open(spark.createDataFrame([], FRAME))
    assert store.render(none, made({})).collect() == []


def test_tiles_are_counted(spark, frames):
    done = spark.sparkContext.accumulator(0)
    p = made({})
    render(frames, p, done=done).collect()
    assert done.value == len(tile_grid(H, W, 48, p.halo)) == 6


def test_service_previews_by_sections(spark, frames, store):
    from emulsa.service import Job, Service

    s, plain = Service(spark, store), Service(spark)
    key, other = s.upload(frames, "a"), plain.upload(frames, "a")
    for dust in (5, 30):
        values = DEFAULTS | BASE | {"dust": dust}
        assert s.preview(key, values, supersample=1) == plain.preview(other, values, supersample=1)
    assert len(store.known()) == 2
    job = Job("x", "y.png", tiles=4, done=spark.sparkContext.accumulator(0))
    s.jobs["x"], told = job, []
    for step in (0, 1, 2, 3):
        job.done.add(step)
        told.append(s.progress("x"))
    assert told == [0, 0.25, 0.75, 1.0]
