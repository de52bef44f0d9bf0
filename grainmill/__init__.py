"""grainmill: prepare, audit and score decision datasets on Apache Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing runs until the caller writes or collects the result, except
where an operator says that it materialises an intermediate table.
"""

__version__ = "0.1.0"
