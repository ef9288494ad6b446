"""Operators for large training corpora (near and exact dedup, quality, chat
formats, token files, line dedup, page extraction, decontamination, web
archives, byte-pair encoding).  Nothing else in the library imports this
subpackage."""
