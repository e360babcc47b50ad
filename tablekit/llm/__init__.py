"""Training-data operators: packing, scans, formatting, archives, scoring, deduplication and decontamination."""
