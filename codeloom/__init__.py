"""Code-graph analytics on PySpark: relations, graph operators, detectors, sinks."""

__version__ = "0.1.0"
