"""Column functions; all of them are built from JVM-side expressions unless they say otherwise."""
