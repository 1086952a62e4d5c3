"""A Spark-native engine that cleans and curates text datasets."""

__version__ = "0.1.0"
