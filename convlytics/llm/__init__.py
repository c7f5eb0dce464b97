"""Training-data operators: joins of near copies, fingerprints, packing,
language, personal data, licences, repeated passages, quality, segmentation
and toxicity.  Nothing else in the library imports this subpackage."""
