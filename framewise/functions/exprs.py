"""Scalar expressions: functions from Columns to Columns, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that results depend on.
KCAL_PER_HARTREE = 627.509474
PKA_FACTOR = 0.004576
GAS_KCAL = 0.00198720425864083
KJ_PER_KCAL = 4.184
#: Factors to ps and to kcal/mol.
TIME_UNITS = {"fs": 1e-3, "ps": 1.0, "ns": 1e3, "us": 1e6, "ms": 1e9, "s": 1e12}
ENERGY_UNITS = {"kcal": 1.0, "kj": 1 / KJ_PER_KCAL, "hartree": KCAL_PER_HARTREE, "ev": 23.060548}


def modulo(a: Column, n: float) -> Column:
    """Remainder in [0, n)."""
    return a - n * F.floor(a / n)


def wrap_deg(a: Column) -> Column:
    """Angle to [-180, 180)."""
    return modulo(a + 180, 360.0) - 180


def range360(a: Column) -> Column:
    return modulo(a, 360.0)


def branch_near(a: Column, target: Column) -> Column:
    """The angle's 360-degree branch nearest target."""
    return target + modulo(a - target + 180, 360.0) - 180


def planar_deviation(phi: Column) -> Column:
    """Degrees from the nearest planar torsion (0 or 180)."""
    return F.abs(modulo(phi + 90, 180.0) - 90)


def to_ps(t: Column, unit: str) -> Column:
    return t * TIME_UNITS[unit]


def to_kcal(e: Column, unit: str) -> Column:
    return e * ENERGY_UNITS[unit]


def half_k(kappa_kj: Column) -> Column:
    """Wall constant in kJ to the half-K form of a harmonic bias in kcal."""
    return 2 * kappa_kj / KJ_PER_KCAL


def rotamer_label(chi1: Column, chi2: Column) -> Column:
    """t, gp or gm by chi1, then p or m by the sign of chi2."""
    first = F.when(F.abs(chi1) >= 120, "t").when(chi1 >= 0, "gp").otherwise("gm")
    return F.concat(first, F.when(chi2 >= 0, "p").otherwise("m"))


def time_snap(t: Column, step: float) -> Column:
    """The multiple of step at or below t."""
    return F.floor(t / step) * step


def min_image(d: Column, length: Column | float) -> Column:
    """Nearest periodic image of a coordinate difference in an orthorhombic cell (half-to-even rounding)."""
    length = F.lit(length) if isinstance(length, (int, float)) else length
    return d - length * F.rint(d / length)


#: g/cm3 of one water of 18.01528 g/mol in one cubic angstrom.
WATER_G_A3 = 18.01528 / 0.602214076


def water_density(n: Column, volume: Column | float) -> Column:
    """g/cm3 of n waters in a volume in cubic angstrom."""
    return n * WATER_G_A3 / volume


def rescale_box(lengths: list[Column], solute_volume: Column | float, n: Column, target: float) -> list[Column]:
    """Box lengths in fixed ratios whose volume beside the solute holds n waters at the target density."""
    scale = F.cbrt((solute_volume + n * WATER_G_A3 / target) / (lengths[0] * lengths[1] * lengths[2]))
    return [x * scale for x in lengths]


def norm(d: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0]))


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(c: Column) -> Column:
    """c held to [-1, 1]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def angle_deg(a: list[Column], b: list[Column]) -> Column:
    """Angle between two vectors in degrees; null for a zero vector."""
    return F.degrees(F.acos(unit(F.try_divide(dot(a, b), norm(a) * norm(b)))))


def torsion_deg(b1: list[Column], b2: list[Column], b3: list[Column]) -> Column:
    """Signed torsion from three consecutive bond vectors; null if degenerate."""
    return torsion_of(cross(b1, b2), cross(b2, b3), b2)


def torsion_of(n1: list[Column], n2: list[Column], axis: list[Column]) -> Column:
    """Signed angle in degrees from one plane normal to the other about an axis; null if degenerate."""
    y, x = dot(cross(n1, n2), axis) / F.nullif(norm(axis), F.lit(0.0)), dot(n1, n2)
    # Spark's atan2 takes -0.0 for 0.0; a flat trans torsion keeps its sign
    below = (x < 0) & (y == 0) & (y.cast("string") == "-0.0")
    return F.when((norm(n1) > 1e-12) & (norm(n2) > 1e-12), F.when(below, F.lit(-180.0)).otherwise(F.degrees(F.atan2(y, x))))


def switching(x: Column, p: int, q: int) -> Column:
    """(1 - x^p) / (1 - x^q), p/q at x = 1."""
    below = 1 - F.pow(x, F.lit(q))
    return F.when(F.abs(below) < 1e-12, F.lit(p / q)).otherwise((1 - F.pow(x, F.lit(p))) / below)


def kernel(z: Column) -> Column:
    return F.exp(-0.5 * z * z)


def log1pexp(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def fermi(x: Column) -> Column:
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), x))))


def bin_of(v: Column, lo: Column | float, width: Column | float, n: int) -> Column:
    """Histogram bin, the last one closed on both sides; null outside."""
    lo, width = (F.lit(c) if isinstance(c, (int, float)) else c for c in (lo, width))
    return F.when((v >= lo) & (v <= lo + width * n), F.least(F.floor((v - lo) / width), F.lit(n - 1)).cast("int"))
