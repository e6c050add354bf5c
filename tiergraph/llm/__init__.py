"""Operators that a large training-data pipeline needs beside the engine's own.

Nothing else in the library imports this subpackage.
"""
