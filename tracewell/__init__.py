"""Provenance analytics over many repositories at once, as Spark plans."""
