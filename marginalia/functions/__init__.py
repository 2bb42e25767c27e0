"""Column functions: text, ranking and exact tests, all evaluated inside the JVM."""
