"""A corpus from documents to resolved references, one job per step over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexmere.operators import chunks as C
from lexmere.operators import store as T
from lexmere.session import stored


def run(documents: DataFrame, responses: DataFrame, target: int = C.TARGET) -> dict[str, DataFrame]:
    """(id, text_content, provider_id, model, llm_mode) and (document_id, chunk_index, response_text) -> the event tables and a summary per document.

    Chunks and parsed events are stored once; all children come from them.
    Responses to chunks that do not exist are left out.
    """
    chunks = stored(C.chunks(documents, target))
    parsed = stored(T.parsed(responses.join(chunks.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_semi")))
    events = stored(T.event_rows(parsed, documents))
    return T.run_tables(documents, chunks, parsed, events)
