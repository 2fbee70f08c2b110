"""Column expressions: text clean-up, comment removal, languages, lines."""
