"""Tidemark: process-health analytics and table processing as keyed Spark DataFrame operators."""
