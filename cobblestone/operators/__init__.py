"""Relational operators over road networks, rasters and street graphs."""
