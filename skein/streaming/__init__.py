"""Graphs that follow a stream of newly declared relations."""
