"""Training-data operators: ten numbered operators and their queries."""
