"""Column expressions: angles, vectors, rounding, ratios, kernels."""
