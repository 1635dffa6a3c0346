"""quern: a PySpark-native engine for numerical and statistical data processing."""
