"""Palettes, and ramps that are even to the eye."""

from __future__ import annotations

import numpy as np

# The published palettes.
TREATMENT = ("#2a78d6", "#1baf7a", "#eda100", "#e87ba4", "#008300", "#4a3aa7")
ZONE_ENDS = ("#86b6ef", "#0d366b")
SURFACE_ENDS = ("#cde2fb", "#0d366b")
RESIDUAL_ENDS = ("#2a78d6", "#e34948")
CHROME = {"surface": "#fcfcfb", "ink": "#0b0b0b", "ink2": "#52514e", "muted": "#898781", "grid": "#e1e0d9", "axis": "#c3c2b7", "midpoint": "#f0efec"}
MISSING = "#eeeeec"
# The sRGB primaries in XYZ and their white point (D65).
TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])


def rgb(colour: str) -> np.ndarray:
    return np.array([int(colour[i : i + 2], 16) for i in (1, 3, 5)]) / 255


def linear(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def _lab(colour: str) -> np.ndarray:
    t = TO_XYZ @ linear(rgb(colour)) / WHITE
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.array([116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])])


def _hex(lab: np.ndarray) -> str:
    y = (lab[0] + 16) / 116
    f = np.array([y + lab[1] / 500, y, y - lab[2] / 200])
    v = np.linalg.solve(TO_XYZ, np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29)) * WHITE)
    v = np.clip(v, 0, 1)
    v = np.where(v <= 0.0031308, 12.92 * v, 1.055 * v ** (1 / 2.4) - 0.055)
    return "#" + "".join(f"{round(255 * x):02x}" for x in np.clip(v, 0, 1))


def ramp(stops: tuple[str, ...], n: int) -> list[str]:
    """n colours from the first stop to the last at even steps of Lab."""
    if n == 1:
        return [stops[0]]
    lab = np.array([_lab(c) for c in stops])
    at = np.linspace(0, len(stops) - 1, n)
    out = [_hex(np.array([np.interp(a, range(len(stops)), lab[:, k]) for k in range(3)])) for a in at]
    for k in np.nonzero(at == np.floor(at))[0]:
        out[k] = stops[int(at[k])]
    return out


def ofe_palette(what: str = "treatment", n: int = 5) -> list[str] | dict[str, str]:
    """n colours for treatments, zones, a surface or residuals; 'chrome' gives those of frames and text by name."""
    if what == "chrome":
        return dict(CHROME)
    n = max(1, int(n))
    if what == "treatment":
        return list(TREATMENT[:n]) if n <= len(TREATMENT) else ramp(TREATMENT, n)
    if what == "zone":
        return [ZONE_ENDS[1]] if n == 1 else ramp(ZONE_ENDS, n)
    if what == "surface":
        return ramp(SURFACE_ENDS, n)
    if what == "residual":
        return ramp((RESIDUAL_ENDS[0], CHROME["midpoint"], RESIDUAL_ENDS[1]), n)
    raise ValueError(f"unknown palette: {what}")


def ink_on(fill: str) -> str:
    """Dark or light ink, whichever has more contrast with fill (relative luminance of the public contrast standard)."""
    bright = lambda c: float(linear(rgb(c)) @ np.array([0.2126, 0.7152, 0.0722])) + 0.05
    dark, light, own = bright(CHROME["ink"]), bright(CHROME["surface"]), bright(fill)
    return CHROME["ink"] if own / dark >= light / own else CHROME["surface"]
