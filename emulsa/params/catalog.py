"""The parameter catalogue: one record for each of the controls of a render."""

from __future__ import annotations

from dataclasses import dataclass

# Names of the menus' entries, in index order.
SCATTER_PATTERNS = ("Any", "Cross", "Diagonal", "Box", "Diamond", "Donut", "Star", "Horizontal", "Vertical")
BLEND_MODES = ("Add", "Overlay", "Soft Light", "Hard Light", "Multiply", "Screen")


@dataclass(frozen=True)
class Param:
    key: str
    section: str
    min: float
    max: float
    step: float
    default: float
    unit: str = ""
    spatial: bool = False
    choices: tuple[str, ...] = ()
    toggle: bool = False

    @property
    def label(self) -> str:
        return self.key.replace("_", " ").capitalize()


# Key, range, step, default, unit and kind of each control, by section.
_TABLE = """
[Normalize]
normalize 0 1 1 0 - toggle
highlight_priority 0 1 0.01 0 - -
[Colour Grading]
grade_recover 0 1 0.01 0 - -
grade_recover_radius 4 64 1 32 px spatial
grade_temp -1 1 0.01 0 - -
grade_tint -1 1 0.01 0 - -
grade_exposure -5 5 0.01 0 EV -
grade_shadows -1 1 0.01 0 - -
grade_highlights -1 1 0.01 0 - -
grade_contrast -1 1 0.01 0 - -
grade_black_point 0 0.3 0.005 0 - -
grade_clarity -1 1 0.01 0 - -
grade_clarity_radius 2 48 0.5 14 px spatial
grade_vibrance -1 1 0.01 0 - -
grade_saturation -1 1 0.01 0 - -
lut_amount 0 1 0.01 0 - -
[Pre Blur]
pre_blur 0 10 0.05 0 px spatial
[Pre Sharpen]
pre_sharpen 0 30 0.01 0 - -
pre_sharpen_radius 0.3 8 0.05 1 px spatial
[Grain Structure]
intensity 0 100 0.5 32 % -
grain_size 0.4 10 0.05 1.6 px spatial
shadow_size 0 1 0.01 0.45 - -
clump 0 1 0.01 0.5 - -
octaves 1 10 1 3 - -
roughness 0 1 0.01 0.5 - -
chroma_grain 0 1 0.01 0.35 - -
lum_low 0 0.5 0.005 0.15 - -
lum_high 0.3 1 0.005 0.65 - -
shadow_falloff 0.02 0.5 0.005 0.15 - -
highlight_falloff 0.02 0.5 0.005 0.25 - -
highlight_drop 0 1 0.01 0.85 - -
shadow_drop 0 1 0.01 0.6 - -
seed 0 9999 1 1234 - -
edge_bias 0 1 0.01 0.75 - -
smooth_guard 0 1 0.01 0.85 - -
[Edge Destruction]
highpass_radius 0.5 24 0.05 2 px spatial
edge_sensitivity 0.1 4 0.05 1 x -
edge_chroma_sense 0 1 0.01 1 - -
edge_soften 0 1 0.01 0 - -
edge_soften_radius 0.3 64 0.05 1.5 px spatial
edge_soften_edges_only 0 1 0.01 1 - -
edge_jitter 0 5 0.01 0.3 - spatial
jitter_aniso 0 1 0.01 0 - -
jitter_angle 0 180 1 0 deg -
edge_sand 0 1 0.01 0 - -
edge_sand_grit 0.3 20 0.05 0.8 px spatial
scatter 0 1 0.01 0 - -
scatter_radius 0.5 24 0.1 3 px spatial
scatter_pattern 0 8 1 0 - choices
scatter_spread 0 1 0.01 1 - -
scatter_cell 0.1 5 0.1 1 px spatial
micro_blur 0 3 0.01 0.45 px spatial
edge_erosion 0 1 0.01 0.5 - -
edge_chroma 0 1 0.01 0.5 - -
acutance 0 1 0.01 0.25 - -
[Anti Aliasing]
aa_strength 0 3 0.01 0 - -
aa_radius 0.2 4 0.05 1 px spatial
aa_edge_only 0 1 0.01 0.7 - -
[Halation]
halation 0 1 0.01 0.35 - -
halation_radius 2 80 0.5 24 px spatial
halation_threshold 0.3 1 0.01 0.72 - -
halation_recovery 0 1 0.01 0 - -
halation_hue 0 360 1 11 deg -
halation_blue 0 3 0.01 0 - -
halation_blue_level 0 1 0.005 0.45 - -
halation_blue_falloff 0.02 0.5 0.005 0.25 - -
halation_blue_shift -45 45 1 0 deg -
halation_sat 0 1 0.01 0.86 - -
[Tone Response]
contrast 0 1 0.01 0 - -
toe 0 1 0.01 0 - -
shoulder 0 1 0.01 0 - -
highlight_desat 0 1 0.01 0 - -
brightness -2 2 0.01 0 EV -
vibrance -1 1 0.01 0 - -
base_fog 0 0.08 0.002 0 - -
highlight_warmth -1 1 0.01 0 - -
shadow_warmth -1 1 0.01 0 - -
[Film Texture]
dust 0 400 1 0 - -
dust_balance -1 1 0.01 0 - -
dust_size 0.5 120 0.05 2 px spatial
dust_irregular 0 1 0.01 0 - -
dust_opacity 0 1 0.01 0.85 - -
dust_opacity_var 0 1 0.01 0 - -
dust_lum_var 0 1 0.01 0.5 - -
dust_soften 0 5 0.01 0.35 - -
scratches 0 60 1 0 - -
scratch_width 0.3 20 0.05 1 px spatial
scratch_soften 0 1 0.01 0.35 - -
hair 0 40 1 0 - -
hair_length 20 600 5 160 px spatial
hair_soften 0 1 0.01 0.35 - -
light_leak 0 12 1 0 - -
leak_strength 0 3 0.01 1 - -
leak_size_min 5 3000 1 250 px spatial
leak_size_max 5 3000 1 850 px spatial
leak_feather 1 1500 1 180 px spatial
leak_variation 0 1 0.01 0.7 - -
leak_hue 0 1 0.01 0.3 - -
texture_seed 0 9999 1 77 - -
[Global Grain]
global_blend 0 5 1 0 - choices
global_intensity 0 100 0.5 0 % -
global_size 0.1 20 0.05 1.6 px spatial
global_size_max 0.1 20 0.05 1.6 px spatial
global_chroma 0 1 0.01 0 - -
global_src_r 0 100 0.5 0 % -
global_src_g 0 100 0.5 0 % -
global_src_b 0 100 0.5 0 % -
global_src_l 0 100 0.5 0 % -
global_src_l_pivot 0.05 0.95 0.01 0.5 - -
global_opacity 0 1 0.01 1 - -
global_smooth 0 1 0.01 0 - -
global_mottle 0 1 0.01 0 - -
global_seed 0 9999 1 0 - -
[Sharpening]
sharpen 0 30 0.01 0 - -
sharpen_radius 0.3 8 0.05 1 px spatial
[Output]
master_opacity 0 1 0.01 1 - -
"""


def _read(table: str) -> tuple[Param, ...]:
    section, out = "", []
    for line in table.strip().splitlines():
        if line.startswith("["):
            section = line[1:-1]
            continue
        key, lo, hi, step, default, unit, kind = line.split()
        choices = {"scatter_pattern": SCATTER_PATTERNS, "global_blend": BLEND_MODES}.get(key, ())
        out.append(Param(key, section, float(lo), float(hi), float(step), float(default), unit.replace("-", ""), kind == "spatial", choices, kind == "toggle"))
    return tuple(out)


PARAMS = _read(_TABLE)
BY_KEY = {p.key: p for p in PARAMS}
DEFAULTS = {p.key: p.default for p in PARAMS}
SPATIAL = tuple(p.key for p in PARAMS if p.spatial)
SECTIONS = tuple(dict.fromkeys(p.section for p in PARAMS))
# Controls that are zero in a neutral render.
NEUTRAL_ZERO = tuple("""
normalize highlight_priority grade_recover grade_temp grade_tint grade_exposure grade_shadows grade_highlights grade_contrast
grade_black_point grade_clarity grade_vibrance grade_saturation lut_amount pre_blur pre_sharpen contrast toe shoulder
highlight_desat brightness vibrance base_fog intensity edge_erosion acutance edge_soften edge_sand edge_jitter halation
halation_blue halation_recovery micro_blur scatter aa_strength highlight_warmth shadow_warmth global_intensity global_src_r
global_src_g global_src_b global_src_l sharpen dust scratches hair light_leak
""".split())
