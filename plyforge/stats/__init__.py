"""Measurements: metrics, correlations, ratings, intervals."""
