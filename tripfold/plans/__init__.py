"""Registered queries: driver tables in the shapes of the operators, and the SQL twin of each query."""
