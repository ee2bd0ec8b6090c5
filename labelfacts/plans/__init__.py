"""Whole plans: nutrition facts, ingredients, barcodes, expiry dates."""
