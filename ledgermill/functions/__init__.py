"""Column expressions shared by the jobs. All are built-in functions, so they stay in codegen."""
