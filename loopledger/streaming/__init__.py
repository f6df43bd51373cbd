"""Continuous scans of arriving snippets."""
