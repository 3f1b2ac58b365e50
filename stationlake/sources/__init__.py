"""Readers and writers: location metadata, raw folders, landed pages, readings tables."""
