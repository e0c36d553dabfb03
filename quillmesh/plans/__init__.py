"""Named queries, chained stages and parameter structs."""
