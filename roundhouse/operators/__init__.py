"""Relational operators with configurable keys."""
