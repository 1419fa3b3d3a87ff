"""Column functions: texts, features, arrays, and the word lists that they use."""
