"""Reception-report analytics and data pipelines as Spark jobs."""
