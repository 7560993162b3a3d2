"""Document-terminology analytics expressed as Spark DataFrame plans."""
