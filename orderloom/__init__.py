"""orderloom: a Spark engine that turns order documents into a checked table of fund orders."""
