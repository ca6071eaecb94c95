"""Plans: operators put together to the jobs that users run."""
