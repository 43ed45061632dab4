"""Plans that derive the tables of a graph."""
