"""Planning a render before any DataFrame exists: binding, elision of neutral renders, overlap and size of tiles."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from emulsa.kernels.marks import scratch_softness
from emulsa.kernels.stages import LAYERS, global_cells
from emulsa.params.catalog import DEFAULTS
from emulsa.params.ops import clamp_supersample, is_neutral, rescale, sanitize, scale_factor

#: Bytes that a working pixel needs while all stages run.
BYTES_PER_PIXEL = 640
MIN_TILE, MAX_TILE, STEP = 128, 2048, 64


@dataclass
class Plan:
    params: dict[str, float]
    supersample: float = 2.0
    scale: float = 1.0
    lut: dict | None = None
    tile: int = 512
    halo: int = 0
    neutral: bool = False
    stages: list[str] = field(default_factory=list)


def active_stages(p: dict[str, float], lut: bool) -> list[str]:
    on = lambda k, least=0.001: abs(p[k]) > least
    gates = {
        "normalize": p["normalize"] >= 0.5, "reconstruct": on("grade_recover"), "white balance": on("grade_temp") or on("grade_tint"), "exposure": on("grade_exposure"), "shadows and highlights": on("grade_shadows") or on("grade_highlights"),
        "contrast": on("grade_contrast"), "black point": on("grade_black_point"), "clarity": on("grade_clarity"), "vibrance": on("grade_vibrance"), "saturation": on("grade_saturation"), "lut": lut and on("lut_amount"),
        "pre-blur": p["pre_blur"] >= 0.05, "pre-sharpen": on("pre_sharpen", 0.01), "grain": p["intensity"] > 0, "edge soften": on("edge_soften", 0.01), "jitter": on("edge_jitter", 0.01), "sand": on("edge_sand", 0.01), "scatter": on("scatter"),
        "micro-blur": p["micro_blur"] >= 0.05, "erosion": on("edge_erosion", 0.01), "acutance": on("acutance", 0.01), "antialias": on("aa_strength"), "halation": on("halation", 0.01), "tone": any(on(k) for k in ("brightness", "contrast", "toe", "shoulder", "highlight_desat", "vibrance", "highlight_warmth", "shadow_warmth", "base_fog")),
        "leaks": p["light_leak"] >= 1, "scratches": p["scratches"] >= 1, "hair": p["hair"] >= 1, "dust": p["dust"] >= 1, "global grain": p["global_opacity"] > 0.001 and any(p[k] > 0.01 for k in LAYERS), "sharpen": on("sharpen", 0.01), "opacity": p["master_opacity"] < 1,
    }
    return [k for k, v in gates.items() if v]


def halo(p: dict[str, float], s: float) -> int:
    """Overlap in working pixels: kernels in a row add, stages that are off add nothing."""
    hp = max(0.3, p["highpass_radius"] * s)
    blurs = 3.3 * hp + (p["micro_blur"] + p["pre_blur"]) * s + max(1.0, 3 * s) + scratch_softness(p, s)
    if abs(p["grade_clarity"]) > 0.001:
        blurs += max(0.5, p["grade_clarity_radius"] * s)
    if p["grade_recover"] > 0.001:
        blurs += 1.5 * max(1.0, p["grade_recover_radius"] * s)
    if p["halation"] > 0.01:
        blurs += max(1.0, p["halation_radius"] * s)
    if p["edge_soften"] > 0.01:
        blurs += 1.6 * max(0.3, p["edge_soften_radius"] * s)
    if p["smooth_guard"] > 0.01:
        blurs += 2 * max(1.0, 2.5 * hp)
    sharp = [max(0.3, p[f"{k}_radius"] * s) for k in ("sharpen", "pre_sharpen") if p[k] > 0.01]
    blurs += sum(sharp)
    if p["global_opacity"] > 0.001 and any(p[k] > 0.01 for k in LAYERS):
        blurs += 0.5 * p["global_smooth"] * global_cells(p, s)[1]
    total = 3 * blurs
    if p["edge_jitter"] > 0.01:
        total += 3 * p["edge_jitter"] * max(s, 0.25) + 1
    if p["scatter"] > 0.001:
        total += max(0.5, p["scatter_radius"] * s) + 1
    if p["edge_sand"] > 0.01:
        r = max(0.5, p["edge_sand_grit"] * s) / min(3, max(1, round(max(0.5, p["edge_sand_grit"] * s) / 1.2)))
        total += 3 * (2 * r + 3 * max(0.6, 0.6 * r) + 2)
    if p["aa_strength"] > 0.001:
        r = max(0.2, p["aa_radius"] * s)
        total += 2 * min(3, math.ceil(p["aa_strength"])) * (r + 3 * max(0.7, 0.5 * r, 1.6 * r) + 2)
    return math.ceil(total) + 4


def tile_for(halo_px: int, supersample: float, budget: int = 512 << 20) -> int:
    """The widest core whose padded, supersampled tile fits the budget of one task."""
    side = math.sqrt(budget / BYTES_PER_PIXEL) / supersample - 2 * halo_px
    return int(min(MAX_TILE, max(MIN_TILE, side // STEP * STEP)))


def plan(values: dict | None = None, supersample=2.0, megapixels: float | None = None, reference_mp: float | None = None, lut: dict | None = None, scale: float = 1.0, tile: int | None = None) -> Plan:
    p = sanitize(DEFAULTS if values is None else values)
    if reference_mp and megapixels:
        p = rescale(p, scale_factor(megapixels, reference_mp))
    if lut is None:
        p["lut_amount"] = 0.0
    ss = clamp_supersample(supersample)
    pad = math.ceil(halo(p, scale * ss) / ss) + 4
    pad += pad % 2
    return Plan(p, ss, scale, lut, tile or tile_for(pad, ss), pad, is_neutral(p) or p["master_opacity"] <= 0, active_stages(p, lut is not None))


def tile_grid(h: int, w: int, tile: int, pad: int) -> list[tuple[int, ...]]:
    """(ty, tx, core y_a, y_b, x_a, x_b, padded y_a, y_b, x_a, x_b), disjoint cores that cover the frame."""
    out = []
    for ty, y in enumerate(range(0, h, tile)):
        for tx, x in enumerate(range(0, w, tile)):
            yb, xb = min(h, y + tile), min(w, x + tile)
            out.append((ty, tx, y, yb, x, xb, max(0, y - pad), min(h, yb + pad), max(0, x - pad), min(w, xb + pad)))
    return out
