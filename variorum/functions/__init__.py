"""Column functions. Every one is a Catalyst expression and stays in the JVM."""
