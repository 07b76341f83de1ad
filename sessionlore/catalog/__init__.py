"""The queries by name, each with the SQL it is compared against."""
