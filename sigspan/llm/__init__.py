"""Training-data operators: ten numbered operators, each in a module of its own."""
