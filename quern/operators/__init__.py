"""Operators over DataFrames: keyword and vector retrieval, fusion, reranking, change detection."""
