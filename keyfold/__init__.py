"""Keyed state and vector analytics on Spark: fold ordered command logs, probe keys, rank vectors."""
