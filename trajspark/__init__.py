"""trajspark: Spark-native analytics over catalogues of robot-demonstration datasets."""

__version__ = "0.1.0"
