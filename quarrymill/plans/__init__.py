"""Named queries: each applies a function or operator to whole tables and is held against SQL where SQL can say it."""
