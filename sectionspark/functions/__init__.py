"""Column expressions: line cleaning, titles, rules, intents, citations."""
