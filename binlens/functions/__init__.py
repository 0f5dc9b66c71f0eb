"""Column builders (pure expressions, JVM-side)."""
