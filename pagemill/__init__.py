"""pagemill: web-page tables in, clean text, typed records and crawl accounts out, on Spark."""
