"""Scalar formulas as JVM expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GAS_CONSTANT = 0.0083144626  # kJ/(mol K)
COULOMB = 332.06

# Residue names to letters, and other spellings of the same residues.
LETTERS = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
ALIASES = {"HID": "HIS", "HIE": "HIS", "HIP": "HIS", "HSD": "HIS", "HSE": "HIS", "HSP": "HIS", "CYX": "CYS", "CYM": "CYS", "ASH": "ASP", "GLH": "GLU", "LYN": "LYS", "MSE": "MET"}

# Caps, water and ions, which belong to no protein.
NON_PROTEIN = ("ACE", "NME", "NH2", "NHE", "CBT", "FOR", "WAT", "HOH", "TIP", "SOL", "NA", "CL", "MG", "ZN")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def residue_name(name: Column) -> Column:
    n = F.upper(F.trim(name))
    return F.coalesce(F.try_element_at(_map(ALIASES), n), n)


def is_protein_name(name: Column) -> Column:
    return ~F.upper(F.trim(name)).isin(*NON_PROTEIN)


def one_letter(name: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(LETTERS), residue_name(name)), F.lit("X"))


def thermal_energy(t: Column) -> Column:
    return t * GAS_CONSTANT


def periodic_difference(a: Column, b: Column, period: Column) -> Column:
    """Distance of two angles on a circle."""
    d = F.abs(a - b) % period
    return F.least(d, period - d)


def nearest_image(x: Column, length: Column) -> Column:
    """A displacement moved by whole cells to its nearest image; half a cell, where two are equally near, becomes -length / 2."""
    return x - length * F.floor(x / length + 0.5)


def log10_with_error(value: Column, error: Column) -> tuple[Column, Column]:
    return F.log10(value), 0.434 * error / value


def saturate(x: Column, top: float) -> Column:
    return top * F.tanh(x / top)


def coulomb(q: Column, r: Column) -> Column:
    return COULOMB * q / r


def lj_repulsion(epsilon: Column, d: Column, r: Column) -> Column:
    return F.sqrt(epsilon) * F.pow(d, F.lit(6)) / F.pow(r, F.lit(12))


def lj_attraction(epsilon: Column, d: Column, r: Column) -> Column:
    return -2 * F.sqrt(epsilon) * F.pow(d, F.lit(3)) / F.pow(r, F.lit(6))


def sigma_epsilon(a: Column, b: Column) -> tuple[Column, Column]:
    """From the A and B coefficients; 1 and 0 where they aren't defined."""
    return F.when(b == 0, 1.0).otherwise(F.pow(F.try_divide(a, b), F.lit(1.0 / 6))), F.when((a == 0) | (b == 0), 0.0).otherwise(F.try_divide(b * b, 4 * a))


def layered(z: Column, layers: Sequence[tuple[float, float, float]], beyond: float) -> Column:
    """Piecewise linear in z from 0: (upper end, value at the lower end, value at the upper end)."""
    out, low = None, 0.0
    for top, a, b in layers:
        value = F.lit(a) + (b - a) * (z - low) / (top - low)
        out = F.when(z < top, value) if out is None else out.when(z < top, value)
        low = top
    return out.otherwise(beyond)


def heaviside(x: Column) -> Column:
    return F.when(x < 0, 0.0).when(x == 0, 0.5).when(x > 0, 1.0)


def natural_spline(x: Column, knots: Sequence[float], values: Sequence[float]) -> Column:
    """The natural cubic spline through the given points (three or more, ascending); null outside of them."""
    n = len(knots)
    h = [b - a for a, b in zip(knots, knots[1:], strict=False)]
    system, right = np.eye(n), np.zeros(n)  # second derivatives; 0 at both ends
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * ((values[i + 1] - values[i]) / h[i] - (values[i] - values[i - 1]) / h[i - 1])
    m = np.linalg.solve(system, right).tolist()
    out = F.when(x < knots[0], F.lit(None).cast("double"))
    for i in range(n - 1):
        a, b = knots[i + 1] - x, x - knots[i]
        piece = (m[i] * a * a * a + m[i + 1] * b * b * b) / (6 * h[i]) + (values[i] / h[i] - m[i] * h[i] / 6) * a + (values[i + 1] / h[i] - m[i + 1] * h[i] / 6) * b
        out = out.when(x <= knots[i + 1], piece)
    return out


def sigmoid_blend(x: Column, centre: float, width: float, inner: float, outer: float) -> Column:
    return inner + (outer - inner) / (1 + F.exp(-(x - centre) / width))


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.try_divide(2 * a * b, a + b)


def rms_distance(a: Column, b: Column) -> Column:
    """Root of the mean squared difference of two number arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def placed_at_angle(a: Sequence[Column], b: Sequence[Column], degrees: float, length: float) -> tuple[list[Column], list[Column]]:
    """Two points at ``length`` from b, at +/- the angle to the direction from b to a, in the plane of that direction and the
    z axis (the y axis if the direction is that of z). a and b: three coordinates each."""

    def unit(v: list[Column]) -> list[Column]:
        n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        return [x / n for x in v]

    u = unit([x - y for x, y in zip(a, b, strict=True)])
    upright = (u[0] * u[0] + u[1] * u[1]) < 1e-12
    # u x z = (u1, -u0, 0); u x y = (-u2, 0, u0)
    normal = unit([F.when(upright, -u[2]).otherwise(u[1]), F.when(upright, 0.0).otherwise(-u[0]), F.when(upright, u[0]).otherwise(0.0)])
    across = [normal[1] * u[2] - normal[2] * u[1], normal[2] * u[0] - normal[0] * u[2], normal[0] * u[1] - normal[1] * u[0]]
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return tuple([o + (c * x + sign * s * y) * length for o, x, y in zip(b, u, across, strict=True)] for sign in (1, -1))


def kcal_to_kj(x: Column) -> Column:
    return x * 4.184


def angstrom_to_nm(x: Column) -> Column:
    return x * 0.1


def signed_round(x: Column, digits: int) -> Column:
    """As round, but a small negative number becomes -0.0, as in SQL engines that round the double itself."""
    rounded = F.round(x, digits)
    return F.when((x < 0) & (rounded == 0), F.lit(-0.0)).otherwise(rounded)
