"""Fuse many unreliable reports into a short, auditable list of events, on Spark."""
