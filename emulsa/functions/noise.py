"""Noise at the coordinates of each row, as columns: all stays in whole-stage code.

The hash takes products modulo 2 ** 64, which SQL's checked arithmetic refuses. Whether arithmetic is checked is settled when a
column is analysed, so the layers of the hash are put over a DataFrame with the setting off; all else, before and after, keeps
what the session says. Each step is a layer of columns over the last: nested, its expressions would multiply.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.kernels.noise import FIELD, M1, M2, MS, MX, MY, OCTAVE

CHECKED, _one_at_a_time = "spark.sql.ansi.enabled", threading.RLock()


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Whole numbers that are analysed inside wrap around; the setting is put back at once."""
    with _one_at_a_time:
        was = spark.conf.get(CHECKED)
        spark.conf.set(CHECKED, "false")
        try:
            yield
        finally:
            spark.conf.set(CHECKED, was)


def _signed(n: int) -> Column:
    n %= 1 << 64
    return F.lit(n - (1 << 64) if n >> 63 else n).cast("bigint")


def _folded(n: Column, by: int) -> Column:
    return n.bitwiseXOR(F.shiftrightunsigned(n, by))


class Layers:
    """A DataFrame with working columns put over it, which columns() takes off again."""

    def __init__(self, df: DataFrame):
        self.df, self.own, self._names = df, df.columns, count()

    def put(self, columns: list[Column]) -> list[Column]:
        taken = {c.lower() for c in self.df.columns}
        names = []
        while len(names) < len(columns):
            name = f"_n{next(self._names)}"
            if name not in taken:
                names.append(name)
        self.df = self.df.withColumns(dict(zip(names, columns, strict=True)))
        return [F.col(n) for n in names]

    def columns(self, named: dict[str, Column]) -> DataFrame:
        kept = [F.col(f"`{c}`") for c in self.own if c not in named]
        return self.df.select(*kept, *[v.alias(k) for k, v in named.items()])


def lattice(layers: Layers, ys: list[Column], xs: list[Column], points: list[tuple[int, int, int]]) -> list[Column]:
    """Values in [0, 1) of (place in ys, place in xs, seed): ys and xs are whole numbers."""
    with wrapping(layers.df.sparkSession):
        axes = layers.put([v.cast("bigint") * _signed(MY) for v in ys] + [v.cast("bigint") * _signed(MX) for v in xs])
        now = layers.put([axes[y] + axes[len(ys) + x] + _signed(seed * MS) for y, x, seed in points])
        for by, factor in ((29, M1), (32, M2)):
            now = layers.put([_folded(v, by) * _signed(factor) for v in now])
        return layers.put([F.shiftrightunsigned(_folded(v, 31), 40) / (1 << 24) for v in now])


def value_fields(layers: Layers, y: Column, x: Column, fields: list[tuple[float, int]]) -> list[Column]:
    """Smooth noise for each (cell, seed)."""
    quintic = lambda f: f * f * f * (f * (6 * f - 15) + 10)
    out = []
    for cell in dict.fromkeys(c for c, _ in fields):
        v, u = layers.put([y / cell, x / cell])
        iy, ix = layers.put([F.floor(v), F.floor(u)])
        fy, fx = layers.put([v - iy, u - ix])
        fy, fx = layers.put([quintic(fy), quintic(fx)])
        seeds = [s for c, s in fields if c == cell]
        at = lattice(layers, [iy, iy + 1], [ix, ix + 1], [(a, b, s) for s in seeds for a in (0, 1) for b in (0, 1)])
        mixed = [(at[k] * (1 - fx) + at[k + 1] * fx) * (1 - fy) + (at[k + 2] * (1 - fx) + at[k + 3] * fx) * fy for k in range(0, len(at), 4)]
        out += zip([(cell, s) for s in seeds], layers.put(mixed), strict=True)
    found = dict(out)
    return [found[f] for f in fields]


def fbm_fields(layers: Layers, y: Column, x: Column, cell: float, seeds: list[int], octaves: int, rough: float) -> list[Column]:
    """Octaves of smooth noise about 0.5, each twice as wide, with one field's variance, for each seed."""
    base = max(0.8, cell)
    weights = [(o, rough**o if o else 1.0) for o in range(max(1, octaves)) if o == 0 or rough > 0]
    total, square = sum(w for _, w in weights), sum(w * w for _, w in weights)
    noise = value_fields(layers, y, x, [(base * 2.0**o, s + OCTAVE * o) for s in seeds for o, _ in weights])
    n = len(weights)
    mean = lambda own: sum((v * w for v, (_, w) in zip(own, weights, strict=True)), F.lit(0.0)) / total
    return layers.put([0.5 + (mean(noise[k * n : (k + 1) * n]) - 0.5) * (total / math.sqrt(square)) for k in range(len(seeds))])


def with_noise(df: DataFrame, kind: str, name: str, seed: int, cell: float = 1.0, field: int = 0) -> DataFrame:
    """df (y and x among its columns) and a column of noise: kind is lattice, cell or value."""
    layers, y, x, s = Layers(df), F.col("y"), F.col("x"), seed + FIELD * field
    if kind == "value":
        return layers.columns({name: value_fields(layers, y, x, [(cell, s)])[0]})
    at = [F.floor(y / cell), F.floor(x / cell)] if kind == "cell" else [F.floor(y), F.floor(x)]
    return layers.columns({name: lattice(layers, at[:1], at[1:], [(0, 0, s)])[0]})


def with_fbm(df: DataFrame, names: list[str], seed: int, cell: float, octaves: int, rough: float) -> DataFrame:
    """df and a column of octave noise for each name: fields 0, 1, ... of the seed."""
    layers = Layers(df)
    return layers.columns(dict(zip(names, fbm_fields(layers, F.col("y"), F.col("x"), cell, [seed + FIELD * k for k in range(len(names))], octaves, rough), strict=True)))


# By scatter pattern first angle, count of directions, diamond, inner radius, short spokes.
STENCILS = ((0, 0, False, 0, 1), (0, 4, False, 0, 1), (45, 4, False, 0, 1), (0, 8, False, 0, 1), (0, 0, True, 0, 1), (0, 0, False, 0.65, 1), (0, 8, False, 0, 0.4), (0, 2, False, 0, 1), (90, 2, False, 0, 1))


def with_scatter(df: DataFrame, amount: float, reach: float, cell: float, seed: int, spread: float, pattern: int) -> DataFrame:
    """df, dy and dx: by how many whole pixels each pixel's colours are fetched, 0 where the gate is shut."""
    first, n, diamond, inner, short = STENCILS[pattern]
    layers = Layers(df)
    at = [F.floor(F.col("y") / max(1.0, cell)), F.floor(F.col("x") / max(1.0, cell))]
    pick, far, gate = lattice(layers, at[:1], at[1:], [(0, 0, seed + 3301 + FIELD * k) for k in range(3)])
    k = F.least(F.floor(pick * n), F.lit(n - 1)) if n else None
    (theta,) = layers.put([math.radians(first) + k * (2 * math.pi / n) if n else pick * (2 * math.pi)])
    c, s = layers.put([F.cos(theta), F.sin(theta)])
    shape = 1 / F.greatest(F.abs(c) + F.abs(s), F.lit(1e-4)) if diamond else F.lit(1.0)
    spoke = F.when(k % 2 == 0, 1.0).otherwise(short) if n else F.lit(1.0)
    (r,) = layers.put([max(0.5, reach) * (inner + (1 - inner) * (1 - spread * far)) * shape * spoke])
    moved = lambda v: F.when(gate < amount, F.rint(r * v)).otherwise(0.0).cast("int")
    return layers.columns({"dy": moved(s), "dx": moved(c)})
