"""DataFrame operators: joins, enrichment, rules, sequences, alerts, reports."""
