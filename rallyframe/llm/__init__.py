"""Operations for large training-text corpora: filtering, scoring, deduplication, mixing, packing."""
