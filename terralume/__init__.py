"""A PySpark analytics engine for pixel tables."""
