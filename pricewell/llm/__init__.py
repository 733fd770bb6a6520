"""Operators that prepare text corpora for model training, run on Spark."""
