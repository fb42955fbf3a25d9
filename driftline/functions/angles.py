"""Angles and wind vectors; directions in degrees clockwise from north."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KNOTS_PER_METRE_PER_SECOND = 1.9438  # fixed value


def wrap_once(angle: Column) -> Column:
    """Bring an angle in [0, 720) back under 360 by one subtraction."""
    return F.when(angle >= 360, angle - 360).otherwise(angle)


def east(speed: Column, direction: Column) -> Column:
    return speed * F.sin(F.radians(direction))


def north(speed: Column, direction: Column) -> Column:
    return speed * F.cos(F.radians(direction))


def direction_of(u: Column, v: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(u, v)) + 360, F.lit(360.0))


def speed_of(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def knots_to_ms(speed: Column) -> Column:
    return speed / KNOTS_PER_METRE_PER_SECOND
