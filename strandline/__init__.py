"""Strandline: point-cloud line extraction, evaluation and text-corpus operators on Spark DataFrames."""
