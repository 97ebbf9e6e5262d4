"""quillmill: text normalization, edit replay and correction analytics on Spark DataFrames."""

__version__ = "0.1.0"
