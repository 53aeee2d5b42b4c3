"""Column expressions of the panel engine; all stay inside the JVM."""
