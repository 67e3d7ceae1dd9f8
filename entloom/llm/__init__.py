"""Operators for preparing training corpora, each over whole tables."""
