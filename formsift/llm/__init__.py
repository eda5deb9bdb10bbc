"""Training-data operators: secret scans, chat formatting, quality rules, page
text, token files, archives, near-duplicates, packing, fingerprints and BPE.

Nothing outside this subpackage imports it."""
