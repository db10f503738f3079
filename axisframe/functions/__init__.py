"""Column expressions: number semantics and calendar."""
