"""Jobs that chain the operators."""
