"""Analytics of voice-agent call telemetry as Spark DataFrame operators."""
