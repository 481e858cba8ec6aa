"""larkspur: a PySpark-native analytics engine that speaks the MySQL dialect."""

__version__ = "0.1.0"
