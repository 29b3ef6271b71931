"""Plan-building operators over samples and vectors."""
