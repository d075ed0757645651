"""Readers for rankings files, pages and payloads, and an offset-driven source."""
