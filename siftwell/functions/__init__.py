"""Column-level building blocks: text, paths, cells, rules, matching."""
