"""muster: emergency-report fusion, triage and evaluation as Spark DataFrame jobs."""
