import numpy as np
import pytest

from emulsa.kernels import marks
from emulsa.kernels.noise import fbm, grain_points, lattice, value_noise
from emulsa.kernels.primitives import blur, box_pool, downscale, resample, upscale, warp
from emulsa.kernels.stages import Place, blend_delta, render, render_supersampled
from emulsa.params.catalog import DEFAULTS, SPATIAL
from emulsa.params.ops import clamp_supersample, is_neutral, neutral_values, rescale, sanitize, scale_factor
from emulsa.plans.planner import halo, plan, tile_grid

H, W = 150, 190
OFF = neutral_values()


@pytest.fixture(scope="module")
def scene():
    y, x = np.mgrid[0:H, 0:W]
    out = np.stack([x / W, y / H, (np.sin(x / 9) + 1) / 2]).astype(np.float32)
    out[:, 40:80, 60:120] = 0.98
    return out


SETS = {
    "defaults": {"halation_radius": 6},
    "edges": {"halation": 0, "edge_soften": 0.8, "edge_sand": 0.8, "scatter": 0.5, "aa_strength": 2, "edge_jitter": 2},
    "grading": {"halation": 0, "grade_recover": 1, "grade_recover_radius": 4, "grade_clarity": 0.5, "grade_clarity_radius": 4, "grade_temp": 0.3, "grade_exposure": 0.4, "pre_blur": 1, "pre_sharpen": 1},
    "marks": {"halation": 0, "dust": 40, "dust_size": 12, "hair": 6, "hair_length": 60, "scratches": 10, "light_leak": 3, "leak_size_min": 30, "leak_size_max": 80},
    "global": {"halation": 0, "global_intensity": 50, "global_src_r": 40, "global_chroma": 0.5, "global_size_max": 4, "global_smooth": 0.5, "sharpen": 1},
}


@pytest.mark.parametrize("supersample", [0.5, 1, 1.5, 2])
@pytest.mark.parametrize("name", SETS)
def test_tiles_make_the_whole(scene, name, supersample):
    p = plan(SETS[name], supersample)
    whole = render_supersampled(scene, p.params, Place(0, 0, H, W, 1.0), p.supersample)
    for _, _, ya, yb, xa, xb, pa, pb, pc, pd in tile_grid(H, W, 64, p.halo):
        part = render_supersampled(np.ascontiguousarray(scene[:, pa:pb, pc:pd]), p.params, Place(pa, pc, H, W, 1.0), p.supersample)
        assert np.abs(part[:, ya - pa : yb - pa, xa - pc : xb - pc] - whole[:, ya:yb, xa:xb]).max() < 2e-3


def test_neutral_is_identity(scene):
    assert plan(OFF).neutral and is_neutral(OFF)
    assert np.abs(render(scene, OFF | {"master_opacity": 1.0}, Place(0, 0, H, W)) - scene).max() < 1e-6


def test_exposure_is_exact():
    x = np.full((3, 8, 8), 0.2, np.float32)
    out = render(x, OFF | {"grade_exposure": 1.0}, Place(0, 0, 8, 8))
    lin = lambda v: ((v + 0.055) / 1.055) ** 2.4
    assert np.abs(lin(out) - 2 * lin(0.2)).max() < 1e-5


def test_lattice_is_the_published_mix():
    m = (1 << 64) - 1

    def one(y, x, seed):
        n = ((x & m) * 0x9E3779B97F4A7C15 + (y & m) * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & m
        for k, f in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
            n = ((n ^ (n >> k)) * f) & m
        return ((n ^ (n >> 31)) >> 40) / (1 << 24)

    lat = lattice(-3, -5, 7, 9, 1234, 2)
    assert all(lat[f, y, x] == np.float32(one(y - 3, x - 5, 1234 + 7919 * f)) for f in (0, 1) for y in range(7) for x in range(9))


@pytest.mark.parametrize("f", [lambda *a: value_noise(*a, 3.3, 5, 2), lambda *a: fbm(*a, 1.6, 5, 3, 4, 0.5), lambda *a: grain_points(*a, 1.2, 3.0, 5, 2, 0.5)])
def test_noise_knows_only_coordinates(f):
    assert np.abs(f(-7, 11, 40, 50)[:, 10:30, 15:45] - f(3, 26, 20, 30)).max() < 2e-5


def test_octaves_keep_the_strength():
    one, many = fbm(0, 0, 256, 256, 1.6, 3, 1, 1, 0.5).std(), fbm(0, 0, 256, 256, 1.6, 3, 1, 5, 0.7).std()
    assert abs(many / one - 1) < 0.1


def test_blur_reflects(scene):
    x = scene[0].astype(np.float64)
    k = np.arange(-6, 7)
    w = np.exp(-k * k / 8.0)
    w /= w.sum()
    p = np.pad(x, 6, mode="reflect")
    rows = sum(wk * p[6 : 6 + H, j : j + W] for j, wk in enumerate(w))
    p = np.pad(rows, ((6, 6), (0, 0)), mode="reflect")
    assert np.abs(sum(wk * p[j : j + H] for j, wk in enumerate(w)) - blur(scene[0], 2.0)).max() < 1e-5


def test_warp_copies_whole_pixels(scene):
    assert np.array_equal(warp(scene, np.full((H, W), 2.0), np.full((H, W), -3.0), True)[:, :-2, 3:], scene[:, 2:, :-3])


def test_resamplers():
    y, x = np.mgrid[0:48, 0:64]
    ramp = np.repeat(((x + y) / 112).astype(np.float32)[None], 3, axis=0)
    assert resample(ramp, 48, 64, False) is ramp and downscale(ramp, 0.9995) is ramp
    back = upscale(downscale(ramp, 0.5), 48, 64)
    assert np.abs(back - ramp)[:, 4:-4, 4:-4].max() < 5e-2 and box_pool(ramp, 2).shape == (3, 24, 32)


@pytest.mark.parametrize("mode", range(1, 4))
def test_blends_are_neutral_at_mid_grey(mode):
    b = np.linspace(0, 1, 49, dtype=np.float32)
    assert np.abs(blend_delta(b, np.zeros_like(b), mode)).max() < 1e-6
    for g in (-1, 1):
        assert -1e-6 <= (b + blend_delta(b, np.full_like(b, g), mode)).min() <= (b + blend_delta(b, np.full_like(b, g), mode)).max() <= 1 + 1e-6


def test_opacity_is_linear(scene):
    p = sanitize({"intensity": 40, "halation": 0})
    full = render_supersampled(scene, p, Place(0, 0, H, W), 1)
    half = render_supersampled(scene, p | {"master_opacity": 0.5}, Place(0, 0, H, W), 1)
    assert np.abs(half - (scene + full) / 2).max() < 1e-6 and render_supersampled(scene, p | {"master_opacity": 0.0}, Place(0, 0, H, W), 1) is scene


@pytest.mark.parametrize("sigma", [2.0, 20.0, 25.0, 90.0])
def test_wide_blurs_equal_a_pass_for_each_tap(sigma, monkeypatch):
    from emulsa.kernels import primitives

    x = np.random.default_rng(3).random((3, 150, 301), np.float32)
    fast = primitives.blur(x, sigma)
    monkeypatch.setattr(primitives, "MANY_TAPS", 10**9)
    assert np.abs(fast - primitives.blur(x, sigma)).max() < 2e-6


def test_sites_do_not_depend_on_their_number():
    p = OFF | {"texture_seed": 77, "dust_size": 12, "hair_length": 60}
    for made, key, few, many in ((marks.specks, "dust", 5, 50), (marks.fibres, "hair", 3, 9)):
        a, b = made(p | {key: few}, 1.0), made(p | {key: many}, 1.0)
        assert all(np.array_equal(a[c], b[c][:few]) for c in a if c not in ("light", "level"))
    a, b = marks.leak_columns(77, 2, 0.7), marks.leak_columns(77, 6, 0.7)
    assert all(np.array_equal(a[c], b[c][:2]) for c in a)


def test_specks_are_those_of_the_formula():
    """Size 0.55 + u2 squared; eccentricity, lobes and softness as published."""
    p = OFF | {"texture_seed": 5, "dust": 30, "dust_size": 10, "dust_irregular": 1, "dust_soften": 0.4, "dust_balance": -0.2}
    c = marks.specks(p, 2.0)
    for k in range(30):
        u = np.random.default_rng(5 * 1_000_003 + 5501 + 7919 * k + 17).random(12)
        r, e = 0.5 * 10 * 2 * (0.55 + u[2] ** 2), u[3] * 0.55
        assert np.allclose(c["axes"][k], [r * (1 + e), r * (1 - e)]) and np.allclose(c["lobes"][k], np.array([0.24, 0.17, 0.12]) * (0.45 + 1.05 * u[11])) and c["light"][k] == (k < round(30 * 0.4))


def test_leaks_lie_on_the_border_that_their_place_names():
    h, w = 60, 100
    for share, want in ((0.0, 0), (0.31, 0), (0.32, 1), (0.49, 1), (0.51, 2), (0.82, 3), (0.999, 3)):
        which, length, t = marks._border(share, h, w)
        assert which == want and length == (w, h, w, h)[want] and 0 <= t <= 1


def test_marks_below_one_draw_nothing(scene):
    p = OFF | {"dust": 0.9, "hair": 0.5, "scratches": 0.9, "light_leak": 0.9}
    assert marks.film_texture(scene, p, Place(0, 0, H, W)) is scene


def test_parameters():
    assert len(DEFAULTS) == 116 and len(SPATIAL) == 23
    s = sanitize({"sharpen": 99, "nonsense": 1, "dust": float("nan"), "contrast": "x", "toe": float("inf")})
    assert s["sharpen"] == 30 and s["dust"] == 0 and s["contrast"] == 0 and s["toe"] == 1 and "nonsense" not in s
    assert scale_factor(24, 6) == 2 and scale_factor(24, None) == 1 and rescale({"grain_size": 2.0, "contrast": 0.5}, 3) == {"grain_size": 6.0, "contrast": 0.5}
    assert [clamp_supersample(x) for x in (1.2, "junk", 9, None)] == [1.0, 2.0, 3.0, 2.0]


def test_halo_grows_with_stages():
    base = halo(OFF, 1.0)
    for k, v in {"edge_sand": 1, "aa_strength": 2, "halation": 1, "grade_clarity": 1, "sharpen": 1, "edge_jitter": 1, "scatter": 1, "scratches": 5}.items():
        assert halo(OFF | {k: v}, 1.0) > base, k
    assert halo(OFF | {"dust": 100, "hair": 5, "normalize": 1}, 1.0) == base
