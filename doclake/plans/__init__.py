"""The registered queries and the SQL that gives the same rows."""

from doclake.plans import document_oracles, document_queries, feature_oracles, feature_queries, more_oracles, more_queries, wide_oracles, wide_queries  # noqa: F401  they register themselves
