"""Relational operators over trips, corridors (edges) and hubs (vertices)."""
