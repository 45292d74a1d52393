"""Spark-native analytics for captions, transcripts, web pages and technical text."""
