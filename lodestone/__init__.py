"""lodestone: job-listing evidence, triage and corpus preparation as Spark jobs."""
