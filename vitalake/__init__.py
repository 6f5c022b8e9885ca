"""vitalake: career documents and events as Spark DataFrames."""

__version__ = "0.1.0"
