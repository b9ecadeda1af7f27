"""A PySpark-native engine for the history of continuous-integration runs."""
