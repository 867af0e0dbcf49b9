"""Plain DataFrame transformations: lookups, pages, joins, groups, hierarchies, writes, policies and time-based state."""
