"""somnotab: clinical sleep-report text to curated tables, as Spark DataFrame transformations."""
