"""quarrystone: a Spark-first analytics engine for family/occurrence tables.

Everything is a function from DataFrames to DataFrames; Catalyst plans it.
"""

__version__ = "0.1.0"
