"""Labelling of real prose (documents, one case per source) against the model."""
import duckdb

from paths import SF_SMALL
from docket.plans.catalog import q_label_similar_documents
import model


def test_documents_match_model(spark):
    rows = duckdb.sql(f"SELECT doc_id, source, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    expected = model.label(rows)
    got = {r.row_id: (r.noccur, r.similar) for r in q_label_similar_documents(spark, SF_SMALL).collect()}
    assert got == expected
