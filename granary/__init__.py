"""Reconciliation, change sets and data-quality operators as Spark DataFrame transformations."""
