"""The stateless text rules on Structured Streaming frames."""
