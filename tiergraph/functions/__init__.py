"""Column functions: identifiers, text, URLs, similarity, scores and estimators."""
