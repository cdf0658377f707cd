"""Spark-native transcript compression, rate-distortion analytics and corpus preparation."""
