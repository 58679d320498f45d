"""Reflectance spectra: 38 bands, 380 to 750 nm in steps of 10 nm."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tintwell.functions.color import Triple, constants, let, num

BANDS = 38

# CIE 1931 matching functions weighted by D65 (X, Y, Z), as in
# spectral.js (MIT licence, Copyright (c) 2025 Ronald van Wijnen), and XYZ to linear sRGB.
MATCHING_X = [0.0000646919989576, 0.0002194098998132, 0.0011205743509343, 0.0037666134117111, 0.011880553603799, 0.0232864424191771, 0.0345594181969747, 0.0372237901162006, 0.0324183761091486, 0.021233205609381, 0.0104909907685421, 0.0032958375797931, 0.0005070351633801, 0.0009486742057141, 0.0062737180998318, 0.0168646241897775, 0.028689649025981, 0.0426748124691731, 0.0562547481311377, 0.0694703972677158, 0.0830531516998291, 0.0861260963002257, 0.0904661376847769, 0.0850038650591277, 0.0709066691074488, 0.0506288916373645, 0.035473961885264, 0.0214682102597065, 0.0125164567619117, 0.0068045816390165, 0.0034645657946526, 0.0014976097506959, 0.000769700480928, 0.0004073680581315, 0.0001690104031614, 0.0000952245150365, 0.0000490309872958, 0.0000199961492222]
MATCHING_Y = [0.000001844289444, 0.0000062053235865, 0.0000310096046799, 0.0001047483849269, 0.0003536405299538, 0.0009514714056444, 0.0022822631748318, 0.004207329043473, 0.0066887983719014, 0.0098883960193565, 0.0152494514496311, 0.0214183109449723, 0.0334229301575068, 0.0513100134918512, 0.070402083939949, 0.0878387072603517, 0.0942490536184085, 0.0979566702718931, 0.0941521856862608, 0.0867810237486753, 0.0788565338632013, 0.0635267026203555, 0.05374141675682, 0.042646064357412, 0.0316173492792708, 0.020885205921391, 0.0138601101360152, 0.0081026402038399, 0.004630102258803, 0.0024913800051319, 0.0012593033677378, 0.000541646522168, 0.0002779528920067, 0.0001471080673854, 0.0000610327472927, 0.0000343873229523, 0.0000177059860053, 0.000007220974913]
MATCHING_Z = [0.000305017147638, 0.0010368066663574, 0.0053131363323992, 0.0179543925899536, 0.0570775815345485, 0.113651618936287, 0.17335872618355, 0.196206575558657, 0.186082370706296, 0.139950475383207, 0.0891745294268649, 0.0478962113517075, 0.0281456253957952, 0.0161376622950514, 0.0077591019215214, 0.0042961483736618, 0.0020055092122156, 0.0008614711098802, 0.0003690387177652, 0.0001914287288574, 0.0001495555858975, 0.0000923109285104, 0.0000681349182337, 0.0000288263655696, 0.0000157671820553, 0.0000039406041027, 0.000001584012587, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
XYZ_TO_LINEAR = (
    (3.2409699419045226, -1.537383177570094, -0.4986107602930034),
    (-0.9692436362808796, 1.8759675015077202, 0.04155505740717559),
    (0.05563007969699366, -0.20397695888897652, 1.0569715142428786),
)

BASES = {"w": (1, 1, 1), "c": (0, 1, 1), "m": (1, 0, 1), "y": (1, 1, 0), "r": (1, 0, 0), "g": (0, 1, 0), "b": (0, 0, 1)}


@lru_cache(maxsize=1)
def response() -> np.ndarray:
    """3 x 38: linear sRGB of a spectrum, one row per channel."""
    return np.array(XYZ_TO_LINEAR) @ np.array([MATCHING_X, MATCHING_Y, MATCHING_Z])


@lru_cache(maxsize=1)
def base_spectra() -> dict[str, list[float]]:
    """Smoothest reflectance curve of each of the seven base colours.

    Rule (S. A. Burns, "Generating reflectance curves from sRGB triplets"):
    minimise the summed squared slope of a transformed curve subject to the
    exact linear sRGB. White uses the logarithm (it may pass 1 a little), the
    others the hyperbolic tangent (they stay between 0 and 1). Newton's method
    on the 41 stationary equations, once per process.
    """
    slope = np.zeros((BANDS, BANDS))
    for i in range(BANDS - 1):
        slope[i : i + 2, i : i + 2] += np.array([[2.0, -2.0], [-2.0, 2.0]])
    t = response()
    out: dict[str, list[float]] = {}
    for name, rgb in BASES.items():
        z, lam = np.zeros(BANDS), np.zeros(3)
        for _ in range(100):
            if name == "w":
                curve, d1, d2 = np.exp(z), np.exp(z), np.exp(z)
            else:
                th = np.tanh(z)
                curve, d1 = (th + 1) / 2, (1 - th * th) / 2
                d2 = -2 * d1 * th
            pull = t.T @ lam
            residual = np.concatenate([slope @ z + d1 * pull, t @ curve - np.array(rgb, float)])
            jacobian = np.block([[slope + np.diag(d2 * pull), d1[:, None] * t.T], [t * d1, np.zeros((3, 3))]])
            move = np.linalg.solve(jacobian, -residual)
            damp = min(1.0, 1.0 / max(1e-12, float(np.abs(move[:BANDS]).max())))
            z, lam = z + damp * move[:BANDS], lam + damp * move[BANDS:]
            if np.abs(move).max() < 1e-12:
                break
        out[name] = [float(v) for v in (np.exp(z) if name == "w" else (np.tanh(z) + 1) / 2)]
    return out


def spectrum_column(values) -> Column:
    return constants([float(v) for v in values])


def base_weights(lin: Triple) -> dict[str, Column]:
    """Amounts of the seven base curves that add up to a linear colour."""
    r, g, b = lin
    w = F.least(r, g, b)
    r, g, b = r - w, g - w, b - w
    zero = num(0)
    return {
        "w": w,
        "c": F.least(g, b),
        "m": F.least(r, b),
        "y": F.least(r, g),
        "r": F.greatest(zero, F.least(r - b, r - g)),
        "g": F.greatest(zero, F.least(g - b, g - r)),
        "b": F.greatest(zero, F.least(b - g, b - r)),
    }


def linear_to_reflectance(lin: Triple) -> Column:
    """38-band reflectance of a linear colour (array of doubles)."""
    weights = F.array(*[base_weights(lin)[k] for k in BASES])
    rows = constants([[base_spectra()[k][i] for k in BASES] for i in range(BANDS)], "array<array<double>>")

    def dot(row: Column, w: Column) -> Column:
        total = F.aggregate(F.zip_with(row, w, lambda a, b: a * b), num(0), lambda acc, v: acc + v)
        return F.greatest(num(2.220446049250313e-16), total)

    return let(weights, lambda w: F.transform(rows, lambda row: dot(row, w)))


def reflectance_to_linear(spectrum: Column) -> Triple:
    """Linear sRGB of a spectrum; may leave 0..1 for very saturated results."""
    t = response()

    def channel(i: int) -> Column:
        return F.aggregate(F.zip_with(spectrum, spectrum_column(t[i]), lambda a, b: a * b), num(0), lambda acc, v: acc + v)

    return channel(0), channel(1), channel(2)
