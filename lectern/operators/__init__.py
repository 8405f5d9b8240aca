"""Operators over tables of chunks, documents and events."""
