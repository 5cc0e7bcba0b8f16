"""Landed payload readers and the source dimension."""
