"""The registered queries: each Spark query next to the SQL that must give the same rows."""
