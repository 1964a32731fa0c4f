"""Quillstone: plans."""
