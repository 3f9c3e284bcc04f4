"""Fixed relations and queries."""
