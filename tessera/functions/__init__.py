"""Column functions: all are built-in expressions that stay in the JVM."""
