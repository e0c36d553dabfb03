"""quillmesh: DataFrame-to-DataFrame analytics for text, graphs, vectors and events on Spark."""

__version__ = "0.1.0"
