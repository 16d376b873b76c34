"""Operators of a large training-data pipeline over documents and embeddings."""
