"""sparkloom: a DataFrame-first operator library for PySpark."""

__version__ = "0.1.0"
