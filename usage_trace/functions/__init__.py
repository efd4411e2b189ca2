"""Column functions: text helpers, classification rules and name extractors."""
