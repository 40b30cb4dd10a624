"""Jobs built from the operators."""
