"""tracewright: PySpark-native analytics over agent trajectories, read intervals and source text."""

__version__ = "0.1.0"
