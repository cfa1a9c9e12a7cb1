"""PySpark-native analytics for long-read transcript alignments."""
