"""Genomic views over the TPC-H-like tables, as one SQL text for every engine."""
