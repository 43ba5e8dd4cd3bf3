"""Column expressions: row-local derivations that stay inside whole-stage codegen."""
