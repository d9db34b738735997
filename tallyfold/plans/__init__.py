"""The registered queries: each reads the given tables and, where SQL can say it, has a SQL twin."""
