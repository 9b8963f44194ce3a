"""Streaming of the agreement-analytics engine."""
