"""Operators of the agreement-analytics engine."""
