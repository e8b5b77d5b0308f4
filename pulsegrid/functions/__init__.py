"""Column functions and Arrow batch kernels."""
