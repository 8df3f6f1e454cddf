"""Relational operators over profile snapshots."""
