"""Scalar functions: numpy kernels for pixels and Column expressions for scores."""
