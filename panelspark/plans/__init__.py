"""Plans: the operators put together into whole analyses."""
