"""frondara: catalogue, retrieval and evidence analytics as Spark DataFrame plans."""
