"""Writers of the summary table, bulk copies, reports and chart points."""
