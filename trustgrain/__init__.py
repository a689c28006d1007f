"""Review trust analytics as Spark DataFrame jobs.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing runs until the caller
asks for a result. See README.md for the data model and the operator list.
"""
