"""Message-log analytics on Spark: capture, slice, measure, replay and export.

A *message log* is an ordinary DataFrame with the columns of
:data:`tidelog.schema.MESSAGE_LOG`.  Every operator takes and returns
DataFrames, is lazy, and leaves the session configuration alone.
"""
