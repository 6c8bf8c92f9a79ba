"""Entity-name harmonization and training-data operators on Spark."""
