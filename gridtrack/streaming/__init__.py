"""Structured Streaming forms: fields from event streams, and the tracker as a stateful operator."""
