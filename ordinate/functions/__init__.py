"""Column functions: IEEE arithmetic without nulls or errors, activations, and functions of array columns."""
