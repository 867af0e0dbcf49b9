"""Column functions: texts, durations, addresses, web paths, mail and identifiers."""
