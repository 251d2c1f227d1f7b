"""Per-file kernels that turn source text into rows."""
