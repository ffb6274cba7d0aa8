"""Plans: whole services built of the operators over a store."""
