"""All queries of this subpackage."""

from . import chunked_bpe, doubling, embeddings, language, licenses, minhash, mixing, phrases, quality, repair, simple8b, suffix, warc  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
