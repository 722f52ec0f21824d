"""DataFrame to DataFrame functions, one module per family of questions."""
