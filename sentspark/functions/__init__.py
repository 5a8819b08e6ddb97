"""Column expressions; all of them stay inside the JVM unless said otherwise."""
