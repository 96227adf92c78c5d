"""Plans over sources, samples and parameters."""
