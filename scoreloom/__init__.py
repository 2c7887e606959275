"""Score banding and decision policy as Spark logical plans."""
