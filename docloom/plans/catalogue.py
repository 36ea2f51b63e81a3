"""All queries of the engine and their SQL."""

from docloom.operators import answers, catalog, chunk_rows, evaluation, headings, ingest, manifest, metadata, pages, quality, question_sets, report_metadata, requests, retrieval, rewriting, runs, sampling, search, table_store, vector_index  # noqa: F401  they register their queries
from docloom.plans.registry import QUERIES, SQL
from docloom.streaming import events as stream_events  # noqa: F401
from docloom.streaming import ingest as stream_ingest  # noqa: F401


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
