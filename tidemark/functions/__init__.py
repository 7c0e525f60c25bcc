"""Scalar functions as Column builders; none of them runs Python on rows."""
