"""quern: incremental text indexing and ranked retrieval as DataFrame plans."""
