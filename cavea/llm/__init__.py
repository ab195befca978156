"""Operators for preparing training text: fingerprints, deduplication, search,
scoring, extraction, mixing and tokenising, each as a Spark job."""
