"""Mergeable statistics over streams."""
