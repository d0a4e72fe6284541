"""gristworks: a PySpark-native engine for semi-structured career text and job postings."""
