"""Predicates, expressions and aggregates as Spark columns."""
