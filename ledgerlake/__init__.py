"""Retail-banking analytics as Spark jobs: ingest, gold views, loans, quality, retrieval, evaluation."""
