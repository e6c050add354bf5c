"""Readers of community text, official tables, web pages and databases, and their state."""
