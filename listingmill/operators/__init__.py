"""Operators over deal-shaped DataFrames: views, merges, rules, matching, resolution, extraction."""
