"""marginalia: document retrieval, review analytics and corpus preparation as Spark jobs."""
