"""vellum: document-retrieval analytics expressed as Spark DataFrame jobs.

Sub-packages:
  functions  Column expressions (text, tags, titles, vectors, reflection tokens, prompts, filters)
  operators  DataFrame -> DataFrame operators (chunking, embedding, kNN, collection upkeep, context)
  sources    scans and snapshot storage (markdown files, collection snapshots, embedding cache)
  streaming  incremental import with Structured Streaming
  plans      end-to-end jobs built from the above (ingest, search, assemble) and derived inputs
"""

__version__ = "0.1.0"
