"""A log-structured, versioned key-value analytics engine on PySpark."""
