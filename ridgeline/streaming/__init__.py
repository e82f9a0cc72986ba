"""Slab-by-slab summaries of volumes that arrive as files (an extension)."""
