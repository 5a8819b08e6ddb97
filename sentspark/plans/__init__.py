"""Table binding, end-to-end runs and the registered queries."""
