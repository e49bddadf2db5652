"""Readers and generators of records, queries and workloads."""
