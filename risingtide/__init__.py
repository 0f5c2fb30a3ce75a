"""Popularity analytics over repeated daily snapshots, as Spark jobs.

``functions``  column expressions (text, time, keys, vectors)
``operators``  DataFrame -> DataFrame building blocks
``sources``    readers; ``sinks`` writers; ``streaming`` incremental ingest
``plans``      the user-level jobs composed from the above
"""
