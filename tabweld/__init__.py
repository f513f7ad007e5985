"""Merging tables with misaligned schemas, as Spark jobs."""

from tabweld.operators.candidates import NoLosslessJoin
from tabweld.operators.clean import clean_data
from tabweld.operators.columns import clean_column_names, validate_schema_compatibility
from tabweld.operators.content_match import content_matches
from tabweld.operators.impute import impute_missing_values
from tabweld.operators.schema_match import match_schemas
from tabweld.plans.merge import match_datasets, merge_datasets, preprocess_datasets

__all__ = [
    "NoLosslessJoin",
    "clean_column_names",
    "clean_data",
    "content_matches",
    "impute_missing_values",
    "match_datasets",
    "match_schemas",
    "merge_datasets",
    "preprocess_datasets",
    "validate_schema_compatibility",
]
