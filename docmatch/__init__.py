"""docmatch: template recognition over document collections, on PySpark."""

__version__ = "0.1.0"
