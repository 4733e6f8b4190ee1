"""Spark-first transit analytics: sources, operators, plans and streaming jobs over DataFrames."""
