"""Drug-development analytics on PySpark: trials in, feature tables and models out."""

__version__ = "0.1.0"
