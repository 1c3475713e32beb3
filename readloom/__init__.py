"""readloom: alignment analytics and record processing as Spark DataFrame plans."""

__version__ = "0.1.0"
