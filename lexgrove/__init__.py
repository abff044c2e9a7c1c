"""lexgrove: annotated text and trees as typed, queryable graph tables on Spark."""
