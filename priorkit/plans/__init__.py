"""Named queries over the star-schema tables, each with the SQL that must give the same rows."""
