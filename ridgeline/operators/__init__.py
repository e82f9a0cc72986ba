"""Operators on volumes, masks, cells and surfaces."""
