"""Plans: the relational tail and whole workflows."""
