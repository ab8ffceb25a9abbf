"""Readers of job records, probes, the summary table and the site lists."""
