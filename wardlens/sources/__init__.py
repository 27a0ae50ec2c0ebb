"""Readers and writers for the cohort tables."""
