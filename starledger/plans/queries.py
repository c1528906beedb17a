"""All queries of the library."""

from . import admission_queries, benchmark_queries, celestial_queries, fusion_queries, graph_queries, image_queries, learning_queries, match_queries, paging_queries, paper_queries, profile_queries, projection_queries, series_queries, source_queries  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401
