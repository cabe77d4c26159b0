"""fleetlens: change, structure and conformance analytics for a fleet of
projects, written as Spark DataFrame and Structured Streaming jobs.

Every table carries a ``project`` column, so one job covers any number of
projects. Operators take and return DataFrames; nothing is collected to the
driver except loop-control counts in the iterative graph job.
"""

__version__ = "0.1.0"
