"""Named queries with the SQL that they are held against."""
