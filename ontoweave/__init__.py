"""Ontology-described business domains computed as Spark DataFrame plans."""

__version__ = "0.1.0"
