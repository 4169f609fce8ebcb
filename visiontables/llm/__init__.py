"""Operators that prepare message logs and their embeddings as training data.

Records are the library's *messages*: ``(message_id, text)`` rows of a model's
message log, *annotations* with their noun phrases, and detection embeddings.
Every operator takes DataFrames and column names and returns a DataFrame.
"""
