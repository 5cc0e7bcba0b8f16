"""Listing-feed analytics expressed as Spark DataFrame plans."""
