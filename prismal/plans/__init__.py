"""The audit session, and queries that check it against SQL."""
