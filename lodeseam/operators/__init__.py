"""DataFrame operators: indexes, ranking, graphs, linking, packing, sessions and evaluation."""
