"""Maintained relational views, change streams and declarative queries on Spark DataFrames."""
