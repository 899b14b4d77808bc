"""Registered queries: each (spark, folder) -> DataFrame, with SQL where SQL can say the same."""
