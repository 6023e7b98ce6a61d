"""Sources: CSV client exports and the derived relation of the test tables."""
