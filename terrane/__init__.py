"""Spark-native analytics over nested market documents."""
