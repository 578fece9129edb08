"""chronoweave: a PySpark-native engine for irregular, multi-channel time series."""

__version__ = "0.1.0"
