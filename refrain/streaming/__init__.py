"""The detection plan as a stream."""
