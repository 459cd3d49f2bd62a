"""Operators over training-data corpora: documents, pages and embeddings in, DataFrames out."""
