"""Developer-activity analytics on PySpark.

Every operator is a function from DataFrames to a DataFrame.  Nothing reads the
clock: callers pass ``as_of``.  All users are computed in one job; pass
``user_id`` to narrow a query to one of them.
"""
