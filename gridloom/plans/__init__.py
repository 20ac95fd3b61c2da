"""The registered queries and their SQL, by topic."""
