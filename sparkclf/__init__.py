"""sparkclf: tabular classification analytics on Spark DataFrames.

Profile a table, detect data-quality issues and score its health, prepare
features with exact stratified splits, tune classifiers with cross-validation,
evaluate and rank them, and assemble report tables.  All heavy work runs as
Spark DataFrame / SQL / ML jobs.
"""
__version__ = "0.1.0"
