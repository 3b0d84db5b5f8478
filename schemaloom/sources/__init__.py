"""Sources: each gives a GraphBatch of lazily evaluated node and edge frames."""
