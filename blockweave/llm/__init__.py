"""Training-data operators (dedup, scans, scoring, tokens, mixing). Nothing outside this subpackage imports it."""
