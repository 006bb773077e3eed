"""Column functions: text, scoring, rules."""
