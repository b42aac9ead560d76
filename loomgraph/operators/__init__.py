"""Part of the graph engine; see the package docstring."""
