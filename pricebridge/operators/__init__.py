"""DataFrame operators: canonical records, the match ladder, aligned equivalences, the canonical overlay, audits."""
