"""Column functions: text, arithmetic and rule lists."""
