"""Colour as column expressions: sRGB light, YCoCg, and the heat map of differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srgb_to_linear(v: Column) -> Column:
    """Light of an sRGB value in 0 to 1; what is at or below 0 is 0."""
    return F.when(v <= 0, 0.0).when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    """The inverse, held in 0 to 1."""
    return F.when(v <= 0, 0.0).when(v >= 1, 1.0).when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def to_ycocg(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return 0.25 * r + 0.5 * g + 0.25 * b, 0.5 * r - 0.5 * b, -0.25 * r + 0.5 * g - 0.25 * b


def from_ycocg(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    return y + co - cg, y + cg, y - co - cg


def over_white(v: Column, alpha: Column) -> Column:
    """A sample with alpha (0 to 255) on a white ground."""
    return v * alpha / 255.0 + 255.0 * (1 - alpha / 255.0)


def difference_level(deltas: list[Column]) -> Column:
    """Eight times the mean absolute difference of three channels, at most 255."""
    return F.least(F.lit(255.0), 8.0 * (F.abs(deltas[0]) + F.abs(deltas[1]) + F.abs(deltas[2])) / 3.0)


def heat(level: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a difference level: dark blue to cyan below 64, to yellow below 128, then to red."""
    half = lambda c: F.floor(c + 0.5)
    low, mid = level < 64, level < 128
    red = F.when(low, 0.0).when(mid, half((level - 64) * 4)).otherwise(255.0)
    green = F.when(low, half(level * 4)).when(mid, 255.0).otherwise(F.greatest(F.lit(0.0), 255 - half((level - 128) * 2)))
    blue = F.when(low, 128 + half(level * 2)).when(mid, 255 - half((level - 64) * 4)).otherwise(0.0)
    return red.cast("int"), green.cast("int"), blue.cast("int")
