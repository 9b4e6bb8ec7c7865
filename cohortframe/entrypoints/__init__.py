"""Named queries over the star-schema tables, each with its SQL twin where SQL can express it."""
