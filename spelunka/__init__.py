"""spelunka: a PySpark-native analytics engine for code intelligence."""

__version__ = "0.1.0"
