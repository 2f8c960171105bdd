"""Readers that turn landed payloads into rows."""
