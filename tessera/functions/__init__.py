"""Column functions: text, numbers, dates and literal matchers."""
