"""Column expressions: geometry, text, vectors and hashes. JVM side throughout."""
