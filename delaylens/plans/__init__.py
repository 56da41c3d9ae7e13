"""Registered query plans (what the entry module exposes) and their SQL twins."""
