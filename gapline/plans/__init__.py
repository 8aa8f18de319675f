"""Whole jobs: cleaning, modelling datasets, training comparison, report tables."""
