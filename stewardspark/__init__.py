"""Data-governance analytics as Spark jobs over DataFrames and Columns."""
