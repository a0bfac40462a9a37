"""Column-level helpers (pure ``Column -> Column`` functions, all JVM-side)."""
