"""Operators Spark lacks, composed from DataFrame operations."""
