"""Quillstone: sources."""
