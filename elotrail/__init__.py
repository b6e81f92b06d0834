"""elotrail: Spark-native ingestion and analytics for archives of rated
two-player game records (PGN dumps) and the rating trajectories in them.

Every public function takes and returns DataFrames; nothing here creates
a SparkSession except :func:`elotrail.session.get_session`.
"""

__version__ = "0.1.0"
