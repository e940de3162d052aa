"""DataFrame-in, DataFrame-out operators, one module per topic."""
