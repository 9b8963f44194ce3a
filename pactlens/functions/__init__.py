"""Functions of the agreement-analytics engine."""
