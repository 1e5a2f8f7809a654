"""Evidence retrieval and question answering as Spark dataflows."""
