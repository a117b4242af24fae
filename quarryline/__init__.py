"""quarryline: a Spark-first analytics engine for software-repository intelligence."""

__version__ = "0.1.0"
