"""The queries of this subpackage, for __spark_entry__.py."""

from . import chroma, mixing, nearest, ngram_join, packing, pii, quality, secret_scan, suffix_dedup, url_filter

MODULES = (secret_scan, suffix_dedup, mixing, quality, nearest, pii, packing, ngram_join, chroma, url_filter)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
