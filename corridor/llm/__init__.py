"""Training-data operators; their queries are registered by ``corridor.llm.queries``."""
