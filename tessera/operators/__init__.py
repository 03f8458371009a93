"""DataFrame operators: statistics, maintenance, space, tiling, vectors and runs."""
