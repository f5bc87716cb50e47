"""The query catalogue: DataFrame plans next to the SQL that states the same result."""
