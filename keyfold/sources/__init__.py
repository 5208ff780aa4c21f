"""Command-log and snapshot data sources."""
