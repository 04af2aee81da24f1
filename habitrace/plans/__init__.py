"""Registered queries: (spark, sf_dir) -> DataFrame, each with its SQL."""
