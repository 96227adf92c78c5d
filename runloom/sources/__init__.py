"""sources of the timeline engine."""
