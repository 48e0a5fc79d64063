"""Type codes, and their place on spheres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter codes by four-letter code, the mapper's table.
CODES = {
    "ILE": "ENTP", "LII": "INTP", "ESE": "ESFJ", "SEI": "ISFJ", "SLE": "ESTP", "LSI": "ISTP", "SEE": "ESFP", "ESI": "ISFP",
    "LIE": "ENTJ", "ILI": "INTJ", "EIE": "ENFJ", "IEI": "INFJ", "LSE": "ESTJ", "SLI": "ISTJ", "EII": "INFP", "IEE": "ENFP",
}

# Three-letter codes with the survey's dichotomies.
SURVEY_TYPES = {
    "ILE": "ENTP", "LII": "INTJ", "SEI": "ISFP", "ESE": "ESFJ", "EIE": "ENFJ", "LSI": "ISTJ", "SLE": "ESTP", "IEI": "INFP",
    "SEE": "ESFP", "ILI": "INTP", "LIE": "ENTJ", "ESI": "ISFJ", "LSE": "ESTJ", "EII": "INFJ", "IEE": "ENFP", "SLI": "ISTP",
}

# The functions of each type, dominant to inferior.
STACKS = {
    "ISTJ": "Si Te Fi Ne", "ISFJ": "Si Fe Ti Ne", "INFJ": "Ni Fe Ti Se", "INTJ": "Ni Te Fi Se",
    "ISTP": "Ti Se Ni Fe", "ISFP": "Fi Se Ni Te", "INFP": "Fi Ne Si Te", "INTP": "Ti Ne Si Fe",
    "ESTP": "Se Ti Fe Ni", "ESFP": "Se Fi Te Ni", "ENFP": "Ne Fi Te Si", "ENTP": "Ne Ti Fe Si",
    "ESTJ": "Te Si Ne Fi", "ESFJ": "Fe Si Ne Ti", "ENFJ": "Fe Ni Se Ti", "ENTJ": "Te Ni Se Fi",
}


def normalized_type(code: Column, strict: bool = False) -> Column:
    """The four-letter type of a four- or three-letter code, else null. With strict, lower-case j and p are the other convention,
    in which they are swapped for introverts."""
    raw, upper = F.trim(code), F.upper(F.trim(code))
    table = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    four = F.when(upper.rlike("^[EI][SN][TF][JP]$"), upper)
    if strict:
        swapped = F.when(upper.startswith("I"), F.translate(F.substring(upper, 4, 1), "JP", "PJ")).otherwise(F.substring(upper, 4, 1))
        four = F.when(raw.rlike("^[EISNTFeisntf]{3}[jp]$") & upper.rlike("^[EI][SN][TF][JP]$"), F.concat(F.substring(upper, 1, 3), swapped)).otherwise(four)
    return F.coalesce(four, F.try_element_at(table, upper))


def type_vector(mbti: Column) -> Column:
    """The type as a unit vector (E, N, F, P), each half of plus or minus one."""
    return F.array(*(F.when(F.substring(mbti, i + 1, 1) == letter, 0.5).otherwise(-0.5) for i, letter in enumerate("ENFP")))


def hopf(v: Column) -> Column:
    """struct(x, y, z): the Hopf map of a point of the 3-sphere."""
    a, b, c, d = (v[i] for i in range(4))
    x, y, z = 2.0 * (a * c + b * d), 2.0 * (b * c - a * d), (a * a + b * b) - (c * c + d * d)
    size = F.sqrt(x * x + y * y + z * z)
    length = F.when(size == 0, 1.0).otherwise(size)
    return F.struct((x / length).alias("x"), (y / length).alias("y"), (z / length).alias("z"))


def lat_lon(p: Column) -> Column:
    """struct(lat, lon) in degrees of a point with y upwards."""
    return F.struct(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p["y"])))).alias("lat"), F.degrees(F.atan2(p["z"], p["x"])).alias("lon"))


def sphere_point(lat: Column, lon: Column, radius: float = 1.001) -> Column:
    """struct(x, y, z) of a latitude and longitude on the rendered globe."""
    phi, theta = F.radians(90 - lat), F.radians(lon + 180)
    return F.struct((-radius * F.sin(phi) * F.cos(theta)).alias("x"), (radius * F.cos(phi)).alias("y"), (radius * F.sin(phi) * F.sin(theta)).alias("z"))


def fibonacci_point(i: Column, n: Column) -> Column:
    """struct(lat, lon): the i-th of n points spread over a sphere by the golden angle."""
    y = i * (2.0 / n) - 1 + 1.0 / n
    r, phi = F.sqrt(1 - y * y), i * F.lit(math.pi * (3 - math.sqrt(5)))
    return F.struct(F.degrees(F.asin(y)).alias("lat"), F.degrees(F.atan2(F.sin(phi) * r, F.cos(phi) * r)).alias("lon"))


def hash_noise(key: Column, seed: int, axis: str) -> Column:
    """A number from -1 to 1 that follows from key, seed and axis alone, wherever the row is computed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{axis}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 31) - 1


def jittered(lat: Column, lon: Column, similarity: Column, key: Column, seed: int, *, spread: float = 12.0, least: float = 2.0) -> Column:
    """struct(lat, lon): a place around a centroid; each coordinate is uniform within spread * (1 - similarity) degrees, `least` at
    least, whatever the similarity."""
    reach = F.greatest(F.lit(least), spread * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))))
    return F.struct((lat + reach * hash_noise(key, seed, "lat")).alias("lat"), (lon + reach * hash_noise(key, seed, "lon")).alias("lon"))


# Weights of the functions of a stack, dominant to inferior.
ROLE_WEIGHTS = (0.5, 0.3, 0.15, 0.05)


def offsets(points: np.ndarray, types: list[str | None], normals: dict[str, tuple[float, float, float]], weights: tuple[float, ...], roll: float, scale: float, max_degrees: float, sign: float) -> np.ndarray:
    """Points moved by the functions of their types: for each function a tangent at the point to its plane, turned by the roll about
    the point, weighted by role; then a turn towards the sum. Unknown types and vanishing sums stay."""
    p = np.asarray(points, float)
    total = np.zeros_like(p)
    known = np.array([t in STACKS for t in types], bool)
    for role, weight in enumerate(weights):
        names = [STACKS[t].split()[role] if t in STACKS else "Ni" for t in types]
        normal = np.array([normals["N" if f[0] in "NS" else "F"] for f in names], float).reshape(-1, 3)
        along = np.cross(normal, p)
        flat = np.linalg.norm(along, axis=1) < 1e-6
        along[flat] = np.cross(normal[flat] + np.array([1e-3, -1e-3, 2e-3]), p[flat])
        angle = np.array([roll if f[1] == "e" else -roll for f in names])
        total += sign * weight * turned(_normed(along), p, angle)
    size = np.linalg.norm(total, axis=1)
    moved = turned(p, _normed(np.cross(_normed(total), p)), np.minimum(scale * size, math.radians(max_degrees)))
    return np.where((known & (size >= 1e-6))[:, None], moved, p)


def _normed(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1.0, n)


def turned(v: np.ndarray, axis: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Unit vectors turned about unit axes (Rodrigues)."""
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    return _normed(v * c + np.cross(axis, v) * s + axis * (1 - c) * (axis * v).sum(1, keepdims=True))


def function_offset(point: Column, mbti: Column, normals: dict[str, tuple[float, float, float]], weights: tuple[float, ...] = ROLE_WEIGHTS, roll: float = 0.1, scale: float = 1.0, max_degrees: float = 12.0, sign: float = -1.0) -> Column:
    """struct(x, y, z): the point moved by its type's functions, weights by role, dominant first. `sign` is the observed -1."""

    @F.pandas_udf("x double, y double, z double")
    def move(x: pd.Series, y: pd.Series, z: pd.Series, types: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(offsets(np.stack([x, y, z], 1), types.tolist(), normals, weights, roll, scale, max_degrees, sign), columns=["x", "y", "z"])

    return move(point["x"], point["y"], point["z"], mbti)
