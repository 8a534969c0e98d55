"""pulsegrid: service-metric anomaly analytics as Spark jobs."""
