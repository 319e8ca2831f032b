"""latticework: gridded-data analytics expressed as Spark DataFrame plans."""
