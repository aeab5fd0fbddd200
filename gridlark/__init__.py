"""Array, statistics and data-preparation operators expressed as Spark plans."""
