"""From trace tables to statistics and reports."""
