"""Plans: what would run, in which order, and how far it got. Nothing here changes state."""
