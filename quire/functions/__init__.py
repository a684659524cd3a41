"""Column functions: row-local, JVM-side, without shuffles."""
