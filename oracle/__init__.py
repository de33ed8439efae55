"""Independent DuckDB formulations of every registered query (the correctness oracle).

The SQL here is written from the report semantics, not generated from the
DataFrame code. Tables ``region nation customer supplier part orders lineitem``
are views registered by the caller.
"""
