"""Lodestone: search-ranking analytics and training-data preparation on PySpark."""
