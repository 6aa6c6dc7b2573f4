"""Plane geometry shared by the feature families, as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def seen_from(heading: Column, ahead_x: Column, ahead_y: Column) -> tuple[Column, Column]:
    """An offset turned into the frame of ``heading`` (radians): its part straight ahead and its part to the left."""
    c, s = F.cos(heading), F.sin(heading)
    return ahead_x * c + ahead_y * s, ahead_y * c - ahead_x * s


def turn_to(heading: Column, ahead_x: Column, ahead_y: Column, at_rest: float) -> Column:
    """Signed degrees from ``heading`` to an offset; a zero offset counts as pointing to the angle ``at_rest`` (radians)."""
    nowhere = (ahead_x == 0) & (ahead_y == 0)
    ahead, left = seen_from(heading, F.when(nowhere, F.lit(math.cos(at_rest))).otherwise(ahead_x), F.when(nowhere, F.lit(math.sin(at_rest))).otherwise(ahead_y))
    return F.degrees(F.atan2(left, ahead))


def along_and_across(length: Column, off_x: Column, off_y: Column, v_x: Column, v_y: Column) -> tuple[Column, Column]:
    """A velocity's parts along an offset of that length and at a right angle to it."""
    return (v_x * off_x + v_y * off_y) / length, (v_y * off_x - v_x * off_y) / length
