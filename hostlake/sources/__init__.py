"""Parsers from tables of raw text to typed rows, and the tables on storage."""
