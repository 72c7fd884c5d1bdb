"""Column-expression helpers (pure, JVM-side, codegen friendly)."""
