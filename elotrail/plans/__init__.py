"""User-level results: named SQL-style reports (queries) and cohort analytics."""
