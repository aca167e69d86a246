"""Document-knowledge analytics on Spark: cleaning, chunking, knowledge units, skill records, similarity, search."""

__version__ = "0.2.0"
