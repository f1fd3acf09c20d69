"""Logs as streams: stateless enrichment and templates whose state lasts across batches."""
