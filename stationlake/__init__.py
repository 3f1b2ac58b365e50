"""Data jobs on station time-series tables, written as Spark DataFrame plans.

Every operator takes and returns DataFrames, with column names and thresholds as
arguments. The canonical long table is ``schemas.READINGS``.
"""
