"""Column functions: lexing, predicates, multisets."""
