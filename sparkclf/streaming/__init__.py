"""Streaming.

Intentionally empty: the analysed workflow profiles, cleans and models one
uploaded table; it has no streaming sources, windows, watermarks or state.
All operators take a DataFrame, so a user who wants per-micro-batch profiling
can call them from ``writeStream.foreachBatch``.
"""
