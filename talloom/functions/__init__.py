"""Column functions; all are built-in expressions and stay in the JVM."""
