"""Column functions: built from Spark built-ins only, no Python in the executor."""
