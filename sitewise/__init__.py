"""sitewise: cohort, time-series and multi-site evaluation jobs on Spark DataFrames."""

__version__ = "0.1.0"
