"""Genomic variant analytics on PySpark."""
