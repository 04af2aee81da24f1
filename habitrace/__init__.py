"""Spark-native analytics for reconstructed indoor scans."""
