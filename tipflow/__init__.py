"""Spark-native analytics for multi-tenant tip and credit distribution data."""
