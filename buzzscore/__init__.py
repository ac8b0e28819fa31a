"""buzzscore: a Spark-native engine that cleans short social posts, turns
their text and engagement into features, and scores them into signals."""

__version__ = "0.1.0"
