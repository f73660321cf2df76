"""Evolution in simulated time."""
