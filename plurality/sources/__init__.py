"""Readers, writers and the star-schema survey view."""
