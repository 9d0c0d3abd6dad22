"""Column builders: every function returns a ``Column`` (JVM-side, codegen-friendly)."""
