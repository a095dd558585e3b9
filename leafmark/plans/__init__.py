"""Named queries over whole tables, with their SQL."""
