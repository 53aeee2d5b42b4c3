"""The weekly roll-up over a stream."""
