"""All queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, bpe, decontaminate, fingerprints, html_text, license_scan, near_dedup, quality, sharding, substring_dedup, token_files, url_filter, whitening

MODULES = (url_filter, license_scan, bpe, quality, sharding, near_dedup, html_text, token_files, decontaminate, fingerprints, substring_dedup, whitening, alignment)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
