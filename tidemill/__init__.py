"""Labelled metric time series on Spark: selection, aggregation, maintenance and ingest as DataFrame plans."""
