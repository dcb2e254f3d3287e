"""Vector maths as column expressions: three double columns make a vector."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Vec(NamedTuple):
    """Three columns; operators build expressions and stay inside code generation."""

    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Vec:
        return cls(*(F.col(f"{prefix}{k}{suffix}") for k in "xyz"))

    @classmethod
    def lit(cls, x: float, y: float, z: float) -> Vec:
        return cls(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))

    def plus(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, k: Column | float) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def least(self, o: Vec) -> Vec:
        return Vec(F.least(self.x, o.x), F.least(self.y, o.y), F.least(self.z, o.z))

    def greatest(self, o: Vec) -> Vec:
        return Vec(F.greatest(self.x, o.x), F.greatest(self.y, o.y), F.greatest(self.z, o.z))

    def finite(self) -> Column:
        return finite(self.x) & finite(self.y) & finite(self.z)

    def where(self, condition: Column, otherwise: Vec) -> Vec:
        return Vec(*(F.when(condition, a).otherwise(b) for a, b in zip(self, otherwise, strict=True)))

    def normalized_or(self, fallback: Vec, least: float = 1e-6) -> Vec:
        """The unit vector, or the fallback where it is too short or not finite."""
        n = self.length()
        ok = finite(n) & (n > least)
        return Vec(*(F.when(ok, a / F.when(ok, n).otherwise(1.0)).otherwise(b) for a, b in zip(self, fallback, strict=True)))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def aliased(self, prefix: str = "", suffix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{k}{suffix}") for k, c in zip("xyz", self, strict=True)]


class Named:
    """The vector of the columns <prefix>x, <prefix>y, <prefix>z, for use as a module's name:
    its expressions are made when they are asked for, as columns need a running session."""

    def __init__(self, prefix: str = ""):
        self._prefix = prefix

    def __getattr__(self, name: str):
        return getattr(Vec.of(self._prefix), name)

    def __iter__(self):
        return iter(Vec.of(self._prefix))

    def __getitem__(self, k: int) -> Column:
        return Vec.of(self._prefix)[k]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(c, as_column(low)), as_column(high))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    """Area, or null where it is no more than 1e-9."""
    area = b.minus(a).cross(c.minus(a)).length() * 0.5
    return F.when(finite(area) & (area > 1e-9), area)


def with_closest_on_triangle(df: DataFrame, p: str = "p", a: str = "a", b: str = "b", c: str = "c", out: str = "q") -> DataFrame:
    """adds the place of the triangle that is closest to p: corner, edge or face.

    The place is a + s (b - a) + t (c - a).  Products, then s and t, then the place are
    projections of their own, so that each is computed once and generated code stays short.
    """
    at, one, two, three = (Vec.of(k) for k in (p, a, b, c))
    ab, ac = two.minus(one), three.minus(one)
    dots = [e.dot(at.minus(corner)) for corner in (one, two, three) for e in (ab, ac)]
    df = df.select("*", *[d.alias(f"__d{k}") for k, d in enumerate(dots, 1)])
    d1, d2, d3, d4, d5, d6 = (F.col(f"__d{k}") for k in range(1, 7))
    df = df.select("*", (d3 * d6 - d5 * d4).alias("__va"), (d5 * d2 - d1 * d6).alias("__vb"), (d1 * d4 - d3 * d2).alias("__vc"))
    va, vb, vc = (F.col(f"__v{k}") for k in "abc")
    over = lambda n, d: n / F.when(d != 0, d).otherwise(1.0)
    edge = over(d4 - d3, (d4 - d3) + (d5 - d6))
    cases = [
        ((d1 <= 0) & (d2 <= 0), F.lit(0.0), F.lit(0.0)),
        ((d3 >= 0) & (d4 <= d3), F.lit(1.0), F.lit(0.0)),
        ((vc <= 0) & (d1 >= 0) & (d3 <= 0), over(d1, d1 - d3), F.lit(0.0)),
        ((d6 >= 0) & (d5 <= d6), F.lit(0.0), F.lit(1.0)),
        ((vb <= 0) & (d2 >= 0) & (d6 <= 0), F.lit(0.0), over(d2, d2 - d6)),
        ((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), 1 - edge, edge),
    ]
    s, t = over(vb, va + vb + vc), over(vc, va + vb + vc)
    for condition, x, y in reversed(cases):
        s, t = F.when(condition, x).otherwise(s), F.when(condition, y).otherwise(t)
    df = df.select("*", s.alias("__s"), t.alias("__t"))
    place = one.plus(ab.times(F.col("__s"))).plus(ac.times(F.col("__t")))
    return df.select("*", *place.aliased(out)).drop(*[f"__d{k}" for k in range(1, 7)], "__va", "__vb", "__vc", "__s", "__t")


def box_distance_squared(p: Vec, low: Vec, high: Vec) -> Column:
    gap = [F.greatest(a - x, x - b, F.lit(0.0)) for x, a, b in zip(p, low, high, strict=True)]
    return gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]


def project_to_tangent(v: Vec, normal: Vec) -> Vec:
    return v.minus(normal.times(v.dot(normal)))


def clamp_length(v: Vec, most: Column | float) -> Vec:
    n = v.length()
    limit = most if isinstance(most, Column) else F.lit(float(most))
    return v.times(F.when(n > limit, limit / F.when(n > 0, n).otherwise(1.0)).otherwise(1.0))


def clamp_speed(v: Vec, most: float) -> Vec:
    """A limit of zero or less stops everything."""
    return clamp_length(v, most) if most > 0 else v.times(0.0)


def rotate_by_quaternion(v: Vec, x: Column, y: Column, z: Column, w: Column) -> Vec:
    """Rotation by the normalised quaternion; null where its length is zero."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    n = F.when(n > 0, n)
    q, s = Vec(x / n, y / n, z / n), w / n
    t = q.cross(v).times(2.0)
    return v.plus(t.times(s)).plus(q.cross(t))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
