"""Kindred: record linkage and text-corpus operators on Spark DataFrames."""
