"""Spark jobs for the tables around machine-read technical drawings."""

__version__ = "0.1.0"
