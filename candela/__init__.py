"""candela: public-integrity analytics expressed as Spark DataFrame jobs."""
