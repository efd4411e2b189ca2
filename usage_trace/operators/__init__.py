"""Operators: tokens, joins of names to their uses, scopes, aliases, accessors, comparison and counters."""
