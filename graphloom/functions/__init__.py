"""Column helpers, distributed ranking, and exact sequential kernels."""
