"""Least squares and mixed models fitted from statistics aggregated in Spark."""
