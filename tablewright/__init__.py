"""Profiling, preparation and classical modelling of tables as Spark jobs."""

__version__ = "0.1.0"
