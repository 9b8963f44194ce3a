"""Sources of the agreement-analytics engine."""
