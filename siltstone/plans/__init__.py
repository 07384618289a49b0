"""Named queries over the tables, with the SQL that each is checked against."""
