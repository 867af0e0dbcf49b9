"""State over time as streams: the same rules as in operators.temporal, kept per key."""
