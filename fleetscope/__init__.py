"""fleetscope: PySpark-native analytics over database-fleet telemetry."""

from fleetscope.keys import K, SK

__all__ = ["K", "SK"]
