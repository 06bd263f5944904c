"""Readers: format detection and one parser for each report format."""
