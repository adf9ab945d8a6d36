"""Operators for preparing training text: sharding, secret scans, tokenising, language
identification, vector search, fingerprints, deduplication and mixing.

Nothing outside this subpackage imports it."""
