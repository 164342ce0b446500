"""Operators of a training-data pipeline: licenses, quality, tokens, language, shards, chats, copies, toxicity, leaks, BPE, vectors, runs, packing."""
