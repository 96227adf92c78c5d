"""streaming of the timeline engine."""
