"""Whole analyses, from raw folders to result tables."""
