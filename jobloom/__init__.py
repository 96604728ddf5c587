"""A Spark-native engine for job postings: extraction, classification, resolution, lifecycle and search."""
