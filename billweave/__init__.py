"""Billing-operations analytics as Spark DataFrame transformations."""
