"""Column-level functions (Column -> Column), all JVM-side except two Arrow UDFs."""
