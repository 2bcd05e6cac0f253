"""Named queries over the driver's tables, by theme; each module has QUERIES and SQL."""
