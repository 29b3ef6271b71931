"""Structured Streaming: ingest of exposition text, and alert states."""
