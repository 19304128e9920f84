"""Point-in-time market and portfolio analytics as Spark plans."""
