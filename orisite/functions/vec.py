"""3-vector and 3x3-matrix algebra that *builds* Spark Column expressions.

Nothing here touches data: each helper returns Columns, so the arithmetic stays inside
whole-stage codegen.  Vectors are three flat DOUBLE columns; a frame is three row vectors
``ex, ey, ez``.  The evaluation order of every sum is fixed (x, then y, then z) so the same
formula written in SQL gives bit-identical doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class V3(NamedTuple):
    x: Column
    y: Column
    z: Column

    @classmethod
    def cols(cls, px: str, py: str, pz: str) -> "V3":
        return cls(F.col(px), F.col(py), F.col(pz))

    @classmethod
    def named(cls, prefix: str = "", suffix: str = "") -> "V3":
        return cls(F.col(f"{prefix}x{suffix}"), F.col(f"{prefix}y{suffix}"), F.col(f"{prefix}z{suffix}"))

    def alias(self, px: str, py: str, pz: str) -> list[Column]:
        return [self.x.alias(px), self.y.alias(py), self.z.alias(pz)]

    def __add__(self, o: "V3") -> "V3":
        return V3(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: "V3") -> "V3":
        return V3(self.x - o.x, self.y - o.y, self.z - o.z)

    def scale(self, s: Column) -> "V3":
        return V3(self.x * s, self.y * s, self.z * s)

    def div(self, s: Column) -> "V3":
        """Component-wise ``try_divide``: NULL instead of an ANSI error when ``s`` is 0."""
        return V3(F.try_divide(self.x, s), F.try_divide(self.y, s), F.try_divide(self.z, s))


def dot(a: V3, b: V3) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def norm(a: V3) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: V3, b: V3) -> V3:
    return V3(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


class M3(NamedTuple):
    """3x3 matrix as three row vectors."""

    r0: V3
    r1: V3
    r2: V3

    @classmethod
    def named(cls, prefix: str) -> "M3":
        """Columns ``{prefix}xx, {prefix}xy, ... {prefix}zz`` (row letter first)."""
        ax = "xyz"
        return cls(*(V3(*(F.col(f"{prefix}{r}{c}") for c in ax)) for r in ax))

    def alias(self, prefix: str) -> list[Column]:
        out = []
        for r, row in zip("xyz", self):
            for c, v in zip("xyz", row):
                out.append(v.alias(f"{prefix}{r}{c}"))
        return out

    def col(self, j: int) -> V3:
        return V3(self.r0[j], self.r1[j], self.r2[j])

    def transpose(self) -> "M3":
        return M3(self.col(0), self.col(1), self.col(2))


def matvec(m: M3, v: V3) -> V3:
    """``m @ v``: one dot product per row."""
    return V3(dot(m.r0, v), dot(m.r1, v), dot(m.r2, v))


def matmul(a: M3, b: M3) -> M3:
    bt = b.transpose()
    return M3(*(V3(dot(row, bt.r0), dot(row, bt.r1), dot(row, bt.r2)) for row in a))


def det3(m: M3) -> Column:
    """Determinant by expansion along the first row (triple product r0 . (r1 x r2))."""
    return dot(m.r0, cross(m.r1, m.r2))


def inv3(m: M3) -> M3:
    """Closed-form inverse, adjugate / det.  Singular ``m`` gives NULL entries, not an error.

    The adjugate's columns are the cross products of the rows, so
    ``inv = [r1 x r2 | r2 x r0 | r0 x r1] / det``.
    """
    c0, c1, c2 = cross(m.r1, m.r2), cross(m.r2, m.r0), cross(m.r0, m.r1)
    d = det3(m)
    adj = M3(V3(c0.x, c1.x, c2.x), V3(c0.y, c1.y, c2.y), V3(c0.z, c1.z, c2.z))
    return M3(*(row.div(d) for row in adj))


#: Rounds of three rotations each; three leave nothing off the diagonal, as a rule.
JACOBI_SWEEPS = 5


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def eigenvalues3(sym: M3) -> Column:
    """Array of the eigenvalues of a symmetric matrix, the largest first.

    Cyclic Jacobi rotations, folded over the six entries on and above the diagonal: the small
    eigenvalues are as exact as the matrix itself allows, which closed forms by cubic roots are not.
    """
    at = {pair: k for k, pair in enumerate((i, j) for i in range(3) for j in range(i, 3))}

    def rotated(a: Column, p: int, q: int) -> Column:
        r = 3 - p - q
        off, rp, rq = a[at[p, q]], a[at[min(r, p), max(r, p)]], a[at[min(r, q), max(r, q)]]

        def by_tangent(t: Column) -> Column:
            def by_cosine(c: Column) -> Column:
                s = t * c
                new = {(p, p): a[at[p, p]] - t * off, (q, q): a[at[q, q]] + t * off, (p, q): F.lit(0.0),
                       (min(r, p), max(r, p)): c * rp - s * rq, (min(r, q), max(r, q)): s * rp + c * rq}
                return F.array(*(new.get(k, a[at[k]]) for k in at))
            return _let(F.lit(1.0) / F.sqrt(t * t + 1.0), by_cosine)

        theta = (a[at[q, q]] - a[at[p, p]]) / (F.lit(2.0) * off)
        tangent = _let(theta, lambda h: F.when(h >= 0, F.lit(1.0) / (h + F.sqrt(h * h + 1.0)))
                       .otherwise(F.lit(-1.0) / (F.sqrt(h * h + 1.0) - h)))
        return F.when(off != 0, _let(tangent, by_tangent)).otherwise(a)

    turns = F.array(*(F.lit(k % 3) for k in range(3 * JACOBI_SWEEPS)))
    done = F.aggregate(turns, F.array(*(sym[i][j] for i, j in at)), lambda a, k: F.when(k == 0, rotated(a, 0, 1))
                       .when(k == 1, rotated(a, 0, 2)).otherwise(rotated(a, 1, 2)))
    return _let(done, lambda a: F.reverse(F.array_sort(F.array(*(a[at[i, i]] for i in range(3))))))
