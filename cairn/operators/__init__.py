"""DataFrame-to-DataFrame operators, one module per family."""
