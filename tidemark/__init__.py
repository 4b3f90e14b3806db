"""Disclosure-event analytics on Spark: declarative DataFrame plans, no per-row Python on the hot paths."""
