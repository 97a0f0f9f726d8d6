"""Bindings of the operators to the driver's tables, each with its SQL check."""
