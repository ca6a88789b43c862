"""News-propagation analytics and training-data operators on PySpark."""

__version__ = "0.1.0"
