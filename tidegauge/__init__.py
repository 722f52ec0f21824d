"""Analytics over a catalogue of measured services, as Spark DataFrame jobs."""
