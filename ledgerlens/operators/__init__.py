"""Operators: filters, global statistics, rank selection and sampling, the isolation
forest, anomaly explanation and ranking, enrichment rules, join strategy."""
