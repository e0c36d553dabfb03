"""Streaming forms of the event operators; each equals its batch form on the same rows."""
