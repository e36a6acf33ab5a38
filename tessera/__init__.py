"""A metadata-driven analytics engine on Spark DataFrames."""
