"""Query operators over the tables of a graph."""
