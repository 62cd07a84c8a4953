"""Analytics over the activity of AI agents and the text they read, on Spark."""
