"""Plans of the agreement-analytics engine."""
