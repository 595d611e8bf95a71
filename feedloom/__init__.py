"""Feedloom: feed discovery, extraction and refresh over whole corpora of pages, payloads and captures on Spark."""
