"""Column expressions. Everything here stays inside Catalyst unless its docstring says otherwise."""
