"""What tasks that encode texts share: the tokenizer file, this worker's
encoder for it (``units.Encoder``), and texts in chunks."""

from __future__ import annotations

from haat.llm.common import kept
from haat.llm.units import Encoder

TOKENS = "tokens"          # the kind of tasks that keep an encoder


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    """This worker's encoder for the file."""
    mine = kept(TOKENS)
    if path not in mine:
        mine[path] = Encoder(path)
    return mine[path]


def in_chunks(ids: list, texts: list, chars: int = 1_000_000):
    """(ids, texts) in runs of about ``chars`` characters; null text as ""."""
    a, n = 0, 0
    for b, t in enumerate(texts):
        texts[b] = t = t or ""
        n += len(t)
        if n >= chars:
            yield ids[a:b + 1], texts[a:b + 1]
            a, n = b + 1, 0
    if a < len(texts):
        yield ids[a:], texts[a:]
