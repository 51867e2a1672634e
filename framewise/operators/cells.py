"""Periodic cells. A box is None (open), a length, three lengths, or the name of a column made by with_cells, one cell a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import min_image

XYZ = ("x", "y", "z")
Box = float | tuple[float, float, float] | str | None

#: Tables of cells up to this many runs are broadcast (about 300 bytes a run).
MOST_RUNS = 100_000


def with_cells(atoms: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("run",), name: str = "cell") -> DataFrame:
    """atoms with a column for pair operators, from cells (keys, cell array<array<double>>), rows of a cell being its vectors, as scan_box gives them.

    The column holds the vectors (m00 to m22), their inverse (i00 to i22), the heights across the three pairs of faces (h0 to h2) and the volume v. Atoms of runs
    without a cell have null there and count as not periodic.
    """
    m = lambda i, j: F.col("cell")[i][j]
    minor = lambda i, j: m((j + 1) % 3, (i + 1) % 3) * m((j + 2) % 3, (i + 2) % 3) - m((j + 1) % 3, (i + 2) % 3) * m((j + 2) % 3, (i + 1) % 3)
    c = cells.select(*keys, "cell", (m(0, 0) * minor(0, 0) + m(0, 1) * minor(1, 0) + m(0, 2) * minor(2, 0)).alias("_det"))
    inverse = [[minor(i, j) / F.col("_det") for j in range(3)] for i in range(3)]
    c = c.select(*keys, "cell", F.abs("_det").alias("_v"), F.array(*[F.array(*row) for row in inverse]).alias("_inv"))
    inv = lambda i, k: F.col("_inv")[i][k]
    height = F.array(*[1 / F.sqrt(inv(0, k) * inv(0, k) + inv(1, k) * inv(1, k) + inv(2, k) * inv(2, k)) for k in range(3)])
    # plain fields: lookups in nested arrays make formulas of pairs longer than the JVM compiles
    flat = [v.alias(f"{n}{i}{k}") for n, at in (("m", m), ("i", lambda i, k: inv(i, k))) for i in range(3) for k in range(3) for v in [at(i, k)]]
    c = c.select(*keys, F.struct(*flat, *[height[k].alias(f"h{k}") for k in range(3)], F.col("_v").alias("v")).alias(name))
    return atoms.join(F.broadcast(c) if c.count() <= MOST_RUNS else c, [*keys], "left")


def fractional(d: list[Column], cell: Column) -> list[Column]:
    """Coordinates in units of the cell's vectors."""
    return [d[0] * cell[f"i0{k}"] + d[1] * cell[f"i1{k}"] + d[2] * cell[f"i2{k}"] for k in range(3)]


def moved(d: list[Column], n: list[Column], cell: Column) -> list[Column]:
    """d less n vectors of the cell; d itself where there is no cell."""
    return [F.coalesce(d[k] - (n[0] * cell[f"m0{k}"] + n[1] * cell[f"m1{k}"] + n[2] * cell[f"m2{k}"]), d[k]) for k in range(3)]


def imaged(d: list[Column], box: Box, cell: Column | None = None) -> list[Column]:
    """Differences of coordinates in their nearest image: whole cell vectors are taken off, as many as the rounded fractional difference (half to even). cell: the column where box names one."""
    if box is None:
        return d
    if isinstance(box, str):
        return moved(d, [F.rint(f) for f in fractional(d, cell)], cell)
    return [min_image(x, length) for x, length in zip(d, lengths(box))]


def lengths(box: float | tuple[float, float, float]) -> tuple[float, ...]:
    return tuple(box) if isinstance(box, (tuple, list)) else (box,) * 3


def volume(box: Box, cell: Column | None = None) -> Column:
    if isinstance(box, str):
        return cell["v"]
    a, b, c = lengths(box)
    return F.lit(float(a * b * c))


class Grid:
    """Cells no smaller than a cutoff: `home`, the cell of a position, and `spread`, the shifts to the cells around it.

    An axis of one cell has no neighbours, one of two has one, others have two, so no cell is looked at twice. A pair
    within the cutoff differs by at most one cell an axis: its fractional difference is at most the cutoff over the
    height across the axis, and cells are at least as wide. For the same reason a position is in reach of a neighbour only
    where it lies within the cutoff of the face between them. Axes of six cutoffs or more take cells of two, so that a
    position has 8 copies on average where cells of one cutoff give it 27.
    """

    def __init__(self, box: Box, cutoff: float):
        self.box, self.cutoff = box, cutoff * (1 + 1e-9)  # a rounding of the width must not hide a pair
        self.fixed = None if isinstance(box, str) or box is None else [max(1, int(length // self.cutoff)) for length in lengths(box)]

    def useful(self) -> bool:
        """Whether cells can leave out anything: more of them than one and its neighbours. Cells by run are decided by row."""
        if self.fixed is None:
            return self.box is not None
        return self.fixed[0] * self.fixed[1] * self.fixed[2] > 27

    def counts(self, cell: Column | None) -> list[Column]:
        if self.fixed is not None:
            return [F.lit(n // 2 if n >= 6 else n) for n in self.fixed]
        n = [F.coalesce(F.greatest(F.lit(1), F.floor(cell[f"h{k}"] / self.cutoff).cast("int")), F.lit(1)) for k in range(3)]
        return [F.when(c >= 6, F.floor(c / 2).cast("int")).otherwise(c) for c in n]

    def scaled(self, at: list[Column], cell: Column | None, n: list[Column]) -> list[Column]:
        """Coordinates in cells."""
        f = fractional(at, cell) if self.fixed is None else [x / length for x, length in zip(at, lengths(self.box))]
        return [x * c for x, c in zip(f, n)]

    def home(self, at: list[Column], cell: Column | None, n: list[Column]) -> list[Column]:
        return [F.coalesce(F.pmod(F.floor(x), c).cast("int"), F.lit(0)) for x, c in zip(self.scaled(at, cell, n), n)]

    def reach(self, cell: Column | None, n: list[Column]) -> list[Column]:
        """The cutoff in cells, an axis each."""
        heights = [cell[f"h{k}"] for k in range(3)] if self.fixed is None else [F.lit(float(length)) for length in lengths(self.box)]
        return [self.cutoff * c / h for c, h in zip(n, heights)]

    def spread(self, df: DataFrame, n: list[Column], half: bool) -> DataFrame:
        """df (with `scaled` as _ux, _uy, _uz and `reach` as _rx, _ry, _rz) with a row for each shift (_ox, _oy, _oz): all neighbours in reach, or, where every axis has three cells or more and half is set, the half of them whose mirror images are not in it."""
        near = [v for k in XYZ for v in ((F.col(f"_u{k}") - F.floor(f"_u{k}") <= F.col(f"_r{k}")).alias(f"_l{k}"), (F.floor(f"_u{k}") + 1 - F.col(f"_u{k}") <= F.col(f"_r{k}")).alias(f"_h{k}"))]
        df = df.select("*", *near).drop(*[f"_{v}{k}" for k in XYZ for v in "ur"])
        for k, c in zip(XYZ, n):
            o, low, high = F.col(f"_o{k}"), F.col(f"_l{k}"), F.col(f"_h{k}")
            df = df.withColumn(f"_o{k}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
            df = df.where((o == 0) | ((c == 2) & (o == 1) & (low | high)) | ((c > 2) & (((o == -1) & low) | ((o == 1) & high)))).drop(f"_l{k}", f"_h{k}")
        if not half:
            return df
        upper = (F.col("_ox") > 0) | ((F.col("_ox") == 0) & ((F.col("_oy") > 0) | ((F.col("_oy") == 0) & (F.col("_oz") >= 0))))
        return df.where(upper | ~self.wide(n))

    def wide(self, n: list[Column]) -> Column:
        return (n[0] >= 3) & (n[1] >= 3) & (n[2] >= 3)
