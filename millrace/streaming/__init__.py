"""Structured Streaming forms of ingest, KPI and detection."""
