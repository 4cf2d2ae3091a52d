"""Reusable DataFrame operators: latest-per-key, de-dup, load rules, quality."""
