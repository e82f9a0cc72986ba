"""Ridgeline: a PySpark engine for gridded 2-D/3-D scalar fields.

A volume is a DataFrame.  Two layouts are used throughout:

* trace layout  - one row per ``(i3, i2)`` with one ``ARRAY<FLOAT>`` per
  attribute; this is what is shuffled, because it carries almost no key bytes;
* voxel layout  - one row per ``(i3, i2, i1)``; this is what is aggregated,
  filtered and joined.
"""

__version__ = "0.1.0"
