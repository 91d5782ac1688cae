"""SQL text of the scalar functions, for the queries' oracles. Numbers are written as doubles."""

from __future__ import annotations

LUMA = (0.2126, 0.7152, 0.0722)


def n(v: float) -> str:
    t = repr(float(v))
    return f"({t})" if "e" in t else f"({t}e0)"


def q(x: str) -> str:
    return f"cast(floor(({x}) * 1e6 + 0.5e0) as bigint)"


def clamp(x: str, lo: float = 0, hi: float = 1) -> str:
    return f"greatest({n(lo)}, least({n(hi)}, {x}))"


def linear(x: str) -> str:
    return f"(case when {x} < 0 then 0e0 when {x} <= 0.04045e0 then {x} / 12.92e0 else pow(({x} + 0.055e0) / 1.055e0, 2.4e0) end)"


def display(x: str) -> str:
    return f"(case when {x} < 0 then 0e0 when {x} <= 0.0031308e0 then {x} * 12.92e0 else 1.055e0 * pow({x}, {n(1 / 2.4)}) - 0.055e0 end)"


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"({n(LUMA[0])} * {r} + {n(LUMA[1])} * {g} + {n(LUMA[2])} * {b})"


def ramp(e0: float, e1: float, x: str) -> str:
    return clamp(f"(({x}) - {n(e0)}) / {n(e1 - e0)}")


def smooth(t: str) -> str:
    return f"({t} * {t} * (3 - 2 * {t}))"


def smoother(t: str) -> str:
    return f"({t} * {t} * {t} * ({t} * (6 * {t} - 15) + 10))"


def steps(source: str, *layers: dict[str, str]) -> str:
    """source with columns put over it, layer by layer; a layer may replace a column."""
    for layer in layers:
        source = f"select * replace ({', '.join(f'{e} as {c}' for c, e in layer.items() if c in REPLACED)}) from ({source})" if all(c in REPLACED for c in layer) else f"select *, {', '.join(f'{e} as {c}' for c, e in layer.items())} from ({source})"
    return source


#: Columns that every plate has, and so are replaced rather than added.
REPLACED = {"r", "g", "b"}


def rgb(f) -> dict[str, str]:
    return {c: f(c) for c in "rgb"}


def out(source: str, columns: dict[str, str], keys: str = "image_id") -> str:
    return f"select {keys}, {', '.join(f'{q(e)} as {c}' for c, e in columns.items())} from ({source})"
