"""Renderers and the end-to-end corpus build."""
