"""A PySpark engine for provenance-aware knowledge registries and training-data pipelines."""
