"""Coordinate transformations. Each maps a list of columns to a list of columns; inverses are computed on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Transform:
    def apply(self, x: list[Column]) -> list[Column]:
        raise NotImplementedError

    def inverse(self) -> Transform | None:
        """The inverse, or None if there is none in closed form."""
        return None


@dataclass(frozen=True)
class Identity(Transform):
    def apply(self, x):
        return list(x)

    def inverse(self):
        return self


@dataclass(frozen=True)
class MapAxis(Transform):
    """Output ``i`` is input ``axes[i]``."""

    axes: tuple[int, ...]

    def apply(self, x):
        return [x[k] for k in self.axes]

    def inverse(self):
        if sorted(self.axes) != list(range(len(self.axes))):
            return None
        return MapAxis(tuple(self.axes.index(k) for k in range(len(self.axes))))


@dataclass(frozen=True)
class ProjectAxis(Transform):
    """Some inputs dropped, zeros put in at places of the output."""

    drop: tuple[int, ...] = ()
    zeros: tuple[int, ...] = ()

    def apply(self, x):
        out = [c for k, c in enumerate(x) if k not in self.drop]
        for k in sorted(self.zeros):
            out.insert(k, F.lit(0.0))
        return out

    def inverse(self):
        return None if self.drop else ProjectAxis(drop=self.zeros)


@dataclass(frozen=True)
class Scale(Transform):
    by: tuple[float, ...]

    def apply(self, x):
        return [c * F.lit(float(s)) for c, s in zip(x, self.by, strict=True)]

    def inverse(self):
        return None if 0 in self.by else Scale(tuple(1 / s for s in self.by))


@dataclass(frozen=True)
class Translation(Transform):
    by: tuple[float, ...]

    def apply(self, x):
        return [c + F.lit(float(s)) for c, s in zip(x, self.by, strict=True)]

    def inverse(self):
        return Translation(tuple(-s for s in self.by))


@dataclass(frozen=True)
class Affine(Transform):
    """Rows of a matrix with the offset in the last column; the offset is the first term of each sum."""

    matrix: tuple[tuple[float, ...], ...]

    def apply(self, x):
        out = []
        for row in self.matrix:
            total = F.lit(float(row[-1]))
            for a, c in zip(row[:-1], x, strict=True):
                total = total + F.lit(float(a)) * c
            out.append(total)
        return out

    def inverse(self):
        m = np.array(self.matrix, float)
        if m.shape[0] + 1 != m.shape[1] or abs(np.linalg.det(m[:, :-1])) == 0:
            return None
        inv = np.linalg.inv(m[:, :-1])
        return Affine(tuple(tuple(row) for row in np.column_stack([inv, -inv @ m[:, -1]]).tolist()))


def rotation(matrix) -> Affine:
    m = np.array(matrix, float)
    if m.shape[0] != m.shape[1] or not np.allclose(m @ m.T, np.eye(len(m)), atol=1e-6):
        raise ValueError("a rotation needs an orthogonal square matrix")
    return Affine(tuple((*row, 0.0) for row in m.tolist()))


@dataclass(frozen=True)
class Sequence(Transform):
    parts: tuple[Transform, ...]

    def apply(self, x):
        return reduce(lambda now, t: t.apply(now), self.parts, list(x))

    def inverse(self):
        back = [t.inverse() for t in reversed(self.parts)]
        return None if None in back else Sequence(tuple(back))


@dataclass(frozen=True)
class Bijection(Transform):
    """A transform with its inverse given."""

    forward: Transform
    backward: Transform

    def apply(self, x):
        return self.forward.apply(x)

    def inverse(self):
        return Bijection(self.backward, self.forward)


@dataclass(frozen=True)
class ByDimension(Transform):
    """Transforms of groups of axes: (input axes, output axes, transform)."""

    parts: tuple[tuple[tuple[int, ...], tuple[int, ...], Transform], ...]

    def apply(self, x):
        out: dict[int, Column] = {}
        for inputs, outputs, t in self.parts:
            out |= dict(zip(outputs, t.apply([x[k] for k in inputs]), strict=True))
        if sorted(out) != list(range(len(out))):
            raise ValueError("the groups don't cover every output axis once")
        return [out[k] for k in range(len(out))]

    def inverse(self):
        back = [(o, i, t.inverse()) for i, o, t in self.parts]
        return None if any(t is None for _, _, t in back) else ByDimension(tuple(back))


def transform_points(df: DataFrame, axes: list[str], t: Transform, names: list[str] | None = None) -> DataFrame:
    """Points with their axes transformed; other columns stay."""
    made = t.apply([F.col(a).cast("double") for a in axes])
    names = names or axes[: len(made)] + [f"out{k}" for k in range(len(axes), len(made))]
    rest = [c for c in df.columns if c not in axes and c not in names]
    return df.select(*rest, *[c.alias(n) for c, n in zip(made, names, strict=True)])


def field_at(points: DataFrame, key: str, axes: list[str], field: DataFrame, dims: list[str], shape: tuple[int, ...], values: list[str], mode: str = "linear") -> DataFrame:
    """``key`` and the vector of a field (element form) at each point; axes are in field index units.

    Multilinear between the 2^n corners of a cell, or nearest; beyond the field its edge holds. Corners are exploded and
    meet the field in one equi-join; the weights are summed map-side.
    """
    if mode not in ("linear", "nearest"):
        raise ValueError(f"no interpolation {mode!r}")
    at = [F.least(F.greatest(F.col(a).cast("double"), F.lit(0.0)), F.lit(float(n - 1))) for a, n in zip(axes, shape, strict=True)]
    if mode == "nearest":
        corners = points.select(key, *[F.floor(x + F.lit(0.5)).cast("bigint").alias(d) for x, d in zip(at, dims, strict=True)], F.lit(1.0).alias("w"))
    else:
        base = points.select(key, *[x.alias(f"__x{k}") for k, x in enumerate(at)])
        options = []
        for corner in product((0, 1), repeat=len(dims)):
            weight, cells = F.lit(1.0), []
            for k, (c, n) in enumerate(zip(corner, shape, strict=True)):
                x = F.col(f"__x{k}")
                part = x - F.floor(x)
                weight = weight * (part if c else F.lit(1.0) - part)
                cells.append(F.least(F.floor(x).cast("bigint") + c, F.lit(n - 1).cast("bigint")).alias(dims[k]))
            options.append(F.struct(*cells, weight.alias("w")))
        corners = base.select(key, F.explode(F.array(*options)).alias("c")).select(key, "c.*").filter("w <> 0")
    return corners.join(field, dims).groupBy(key).agg(*[F.sum(F.col("w") * F.col(v)).alias(v) for v in values])


def compose_levels(level: list[Transform], image: list[Transform]) -> Sequence:
    """A level's transforms, then those of the whole image."""
    return Sequence((*level, *image))


def coordinate_path(edges: list[tuple[str, str, Transform]], start: str, goal: str) -> Transform | None:
    """The composition along a shortest path between coordinate systems; edges also lead back where an inverse exists."""
    if start == goal:
        return Identity()
    near: dict[str, list[tuple[str, Transform]]] = {}
    for a, b, t in edges:
        near.setdefault(a, []).append((b, t))
        back = t.inverse()
        if back is not None:
            near.setdefault(b, []).append((a, back))
    seen, front = {start: ()}, [start]
    while front:
        following = []
        for node in front:
            for other, t in near.get(node, ()):
                if other not in seen:
                    seen[other] = (*seen[node], t)
                    if other == goal:
                        return Sequence(seen[other])
                    following.append(other)
        front = following
    return None
