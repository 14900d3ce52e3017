"""Plans: the process-health queries over the given tables, with SQL for the same results."""
