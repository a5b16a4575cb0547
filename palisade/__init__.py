"""Palisade: content-safety analytics expressed as Spark plans."""
