"""tickloom: market-data operators for Spark DataFrames.

Every public operator takes DataFrames plus keyword parameters and returns a
DataFrame.  Nothing is collected to the driver inside an operator unless its
docstring names the (small, fixed) size of what it fetches.
"""
