"""Deduplicated storage and cross-site synchronisation as Spark DataFrame plans."""
