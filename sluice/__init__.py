"""Sluice: a Spark-first engine that turns crawled pages and search hits into ranked, de-duplicated tables."""
