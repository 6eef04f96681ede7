"""Column -> Column functions; everything here stays inside the JVM unless its docstring says otherwise."""
