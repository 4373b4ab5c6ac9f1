"""Column builders: text, addresses, numbers, dates, features, geometry."""
