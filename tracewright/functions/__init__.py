"""Column expressions: identifiers, normalisers and search predicates."""
