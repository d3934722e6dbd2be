"""Column functions on text and vectors; all of them stay inside the JVM."""
