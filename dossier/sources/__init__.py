"""Readers for requests, crawled pages and saved findings."""
