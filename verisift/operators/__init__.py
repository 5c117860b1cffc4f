"""Set-based operators: filters, retrieval, evidence, gate, metrics, storage."""
