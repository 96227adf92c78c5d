"""functions of the timeline engine."""
