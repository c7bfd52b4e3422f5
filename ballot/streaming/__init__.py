"""Search of streams of queries against a static corpus."""
