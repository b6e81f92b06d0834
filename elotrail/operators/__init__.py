"""DataFrame -> DataFrame operators built from Spark primitives."""
