"""Schemas shared by the tests of this folder."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
