"""operators of the timeline engine."""
