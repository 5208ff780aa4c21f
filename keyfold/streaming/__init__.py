"""Stateful processors and follower replication."""
