"""A text-retrieval analytics engine expressed as Spark plans."""
