"""Amplicon profiling on Spark: sources, k-mer database, read mapping, abundance estimation."""

__version__ = "0.1.0"
