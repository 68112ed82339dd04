"""Where the vocabulary files of public tokenizers are."""

from __future__ import annotations

import os


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file: in ``folder``, else as the package of public tokenizers names it."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
