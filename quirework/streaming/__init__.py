"""Edit history as a stateful stream."""
