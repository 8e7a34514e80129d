"""Operators for preparing large text corpora: secret scans, near-duplicate
classes, language identification, decontamination, WARC archives, toxicity,
packed token files, subword encoding, quality rules, token counts, exact vector
search, phrase collocations and the fill-in-the-middle transformation."""
