"""Column-expression builders (JVM-side; no Python in the hot path)."""
