"""Part of pagelens."""
