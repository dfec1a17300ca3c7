"""Ledgerlight: retail-operations analytics as lazy Spark DataFrame plans."""
