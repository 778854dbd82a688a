"""Change streams derived from the supplied tables, and the SQL that checks the jobs."""
