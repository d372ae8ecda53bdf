"""Quillspark: alignment, scoring, session analytics and corpus operators on Spark DataFrames."""
