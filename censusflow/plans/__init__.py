"""Whole plans: the fixed stage order, text reports, the command line and the registered queries."""
