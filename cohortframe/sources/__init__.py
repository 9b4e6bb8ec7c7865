"""Readers, writers, repairs, and panels derived from star-schema tables."""
