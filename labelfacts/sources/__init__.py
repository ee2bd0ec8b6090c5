"""Readers, the recogniser adapter, and boxes derived from tables of text."""
