"""ravelin: a PySpark-native engine for sensor-frame streams, object tracks and training-data corpora."""

__version__ = "0.1.0"
