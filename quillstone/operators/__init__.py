"""Quillstone: operators."""
