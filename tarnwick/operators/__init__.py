"""Operators that Spark lacks, composed of DataFrame operations."""
