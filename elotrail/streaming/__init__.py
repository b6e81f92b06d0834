"""Structured Streaming: game records from landing files or a line topic."""
