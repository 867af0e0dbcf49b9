"""Queries and record processing of a content-and-community site, as Spark plans."""
