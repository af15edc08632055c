"""Column -> Column building blocks; all of them stay inside the JVM."""
