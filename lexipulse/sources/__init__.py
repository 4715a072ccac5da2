"""Readers, record projections and search queries of the document sources."""

from . import jsonl, records, search

#: route -> (projection of API records or exported rows, builder of its search query)
ROUTES = {
    "s2": (records.from_semantic_scholar, search.bulk_query),
    "openalex": (records.from_openalex, search.openalex_query),
    "ieee": (records.from_ieee, search.ieee_query),
    "arxiv": (records.from_arxiv, search.arxiv_query),
    "patents": (records.from_warehouse, None),
    "patents_csv": (records.from_patent_csv, None),
}

__all__ = ["ROUTES", "jsonl", "records", "search"]
