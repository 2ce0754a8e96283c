"""contactmill: contact and organisation analytics expressed as Spark plans."""
