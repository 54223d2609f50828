"""Part of the hybrid search engine."""
