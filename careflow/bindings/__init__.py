"""The driver tables seen as care-unit tables, the queries over them and their SQL."""
