"""Time alignment and analysis of independently clocked recordings on Spark."""
