"""Sensor and lab time-series analytics as lazy Spark plans."""

__version__ = "0.1.0"
