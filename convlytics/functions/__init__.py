"""Column-expression helpers (JVM-side) and the few Arrow UDFs we need."""
