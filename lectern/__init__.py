"""lectern: document analytics on Spark — retrieval, page-gated graphs, text cleaning, usage state."""
