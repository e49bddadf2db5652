"""Operators over records (key, value), operation logs (seq, key, value, op) and queries (qid, lo, hi, k)."""
