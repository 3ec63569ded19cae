"""Files of public tokenizers, read on the driver."""

from __future__ import annotations

from pathlib import Path

#: folder of the vocabulary files
TOKENIZERS = "/opt/tokenizers"


def tokenizer_file(name: str, folder: str = TOKENIZERS) -> bytes:
    """Content of a vocabulary file of a few megabytes."""
    return Path(folder, name).read_bytes()
