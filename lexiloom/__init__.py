"""Vocabulary analytics on Spark: term tables, similarity, lexical matching, resolution, policy checks and reports."""
