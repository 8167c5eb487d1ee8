"""Scalar, aggregate and ordered functions as Spark columns."""
