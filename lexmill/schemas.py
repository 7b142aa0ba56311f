"""Schemas of the data model; every frame carries an explicit ordinal where order matters."""

DOCUMENT = "doc_id string, ordinal long, text string, source string, metadata map<string,string>"
CHUNK = "chunk_id string, ordinal long, text string, doc_id string, source string, chunk_index int, metadata map<string,string>"
QUESTION = "question string, answer string, chunk_id string, source string"
RUN = "query_id string, chunk_id string, score double, rank int"
