"""Presets (fixed rule values) and the end-to-end posting plans built from them."""
