"""Named queries over the derived tables, each with its SQL."""
