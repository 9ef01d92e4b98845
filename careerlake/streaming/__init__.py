"""Streaming twins of operators over activity: the same results, kept up as rows arrive."""
