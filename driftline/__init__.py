"""Quality control and time-series analytics for sensor tables, on Spark."""

from driftline.operators.scan import Order
from driftline.session import build_session

__all__ = ["Order", "build_session"]
