"""Timeline, text and vector analytics as DataFrame-to-DataFrame operators on Spark."""
