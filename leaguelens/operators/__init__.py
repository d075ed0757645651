"""Relational building blocks: deduplication, change data, validation, entity resolution, storage."""
