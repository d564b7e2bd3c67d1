"""DataFrame -> DataFrame operators (relational curation, text features, sampling, metrics, models)."""
