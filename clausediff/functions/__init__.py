"""Column functions: text projections and line predicates."""
