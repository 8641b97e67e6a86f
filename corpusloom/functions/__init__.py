"""Column expressions: text, URL, quality and naming functions, all JVM-side."""
