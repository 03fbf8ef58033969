"""Column expressions: text, lists, rule ladders, statistics."""
