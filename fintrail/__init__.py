"""fintrail: transaction-risk analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames over one canonical event model, so
plans compose and Catalyst sees the whole job.
"""
