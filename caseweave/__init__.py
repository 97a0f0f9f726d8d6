"""caseweave: case and incident analytics written as Spark DataFrame operators.

Operators take DataFrames and column names and return DataFrames. Nothing in
the data path is collected; the only driver-side reads are loop-termination
counts and results whose size is bounded by an argument (a row cap, one path).
"""
