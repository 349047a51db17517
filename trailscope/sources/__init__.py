"""Table sources and sinks: fixed schemas, CSV with pandas null tokens, derivation from the driver data."""
