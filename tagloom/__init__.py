"""tagloom: posting and tag analytics expressed as Spark DataFrame operators."""
