"""Exon-graph and splicing analytics written as Spark DataFrame transformations."""
