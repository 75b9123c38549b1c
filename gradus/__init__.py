"""gradus: tabular-benchmark analytics on Spark DataFrames.

Prepares labelled tables, scores predictions, computes dataset metafeatures
and turns trial logs into tuned, normalised and ranked result tables.
"""
