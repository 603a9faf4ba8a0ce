"""Column functions: everything here stays in the JVM unless it says otherwise."""
