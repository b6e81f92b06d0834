"""Scans: driver tables, PGN dumps, month manifests, JDBC, CSV results."""
