"""Catalogue enrichment and analytics expressed as Spark DataFrame plans."""
