"""Training-data operators: language mixture, fingerprints, toxicity, packing,
web archives, near-duplicate join, decontamination, chat formatting, line
deduplication and document quality.  Nothing else in the library imports this
subpackage."""
