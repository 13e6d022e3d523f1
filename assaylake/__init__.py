"""Spark toolkit for preparing, splitting, auditing and evaluating assay tables."""
