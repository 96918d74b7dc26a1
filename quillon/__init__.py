"""Time-indexed signal, sequence and language analytics expressed as Spark plans."""
