"""A PySpark-native analytics engine for uncompressed video and codec telemetry."""
