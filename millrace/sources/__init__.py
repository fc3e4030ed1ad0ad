"""Where events come from: message topics and stored tables."""
