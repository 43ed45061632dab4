"""Where graphs come from: JSON corpora, plain tables, stored snapshots."""
