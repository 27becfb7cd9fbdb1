"""Streams of files, with the semantics that the engine has at rest.

The engine's own model is a batch: a dataset is written once, after all its
chunks. `arrivals` is what carries over to a stream without a change of meaning.
"""
