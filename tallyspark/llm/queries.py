"""The queries of this subpackage and, where SQL can express them, their oracles."""

from . import ann, bpe, jaccard, language, licenses, media, minhash, negatives, packing, pii, spelling, suffixes, urls

MODULES = [ann, pii, licenses, language, minhash, media, bpe, suffixes, packing, urls, negatives, spelling, jaccard]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
