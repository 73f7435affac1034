"""Spark jobs for document retrieval: filters, search, catalogue, ingestion, evaluation."""
