"""Rooftop-PV soiling and cleaning economics as Spark DataFrame operators."""

__version__ = "0.1.0"
