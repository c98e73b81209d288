"""Streaming.

The source project is batch only: it has no streams, watermarks, event-time
windows or stateful operators, so nothing streaming is built here.  Every
operator in :mod:`gridframe.operators` is a plain DataFrame transformation and
can be applied inside ``foreachBatch`` of a Structured Streaming query if a
caller needs to run the cleaning jobs incrementally.
"""
