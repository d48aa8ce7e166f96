"""tracewright: corpus comparison and large-scale record processing on PySpark."""

__version__ = "0.1.0"
