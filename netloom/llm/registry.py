"""The queries of this subpackage and their SQL."""

from . import packing, pairs, setjoin, severity, tokens, topn

_MODULES = [setjoin, topn, pairs, tokens, packing, severity]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
