"""The blocks of quillmesh/blocks.py, for the operators here."""

from quillmesh.blocks import ROWS, WEIGHT, in_pairs, linked_roots, overlaps, runs, with_blocks  # noqa: F401
