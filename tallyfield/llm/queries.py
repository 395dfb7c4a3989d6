"""The queries of this subpackage and their SQL."""

from . import ball_tree, byte_pairs, centroids, decontaminate, fill_middle, html_text, language, mixing, pii, quality, simhash, url_filter, warc

MODULES = (pii, decontaminate, html_text, warc, quality, ball_tree, simhash, url_filter, language, mixing, centroids, fill_middle, byte_pairs)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
