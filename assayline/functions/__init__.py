"""Column expressions: each function takes and returns ``Column`` and stays inside code generation."""
