"""Readers, routing and writers."""
