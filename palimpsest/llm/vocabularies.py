"""Where the files of public tokenizers lie."""

from __future__ import annotations

import importlib


def vocabulary(name: str, package: str = "public_tokenizers") -> str:
    """The path of a vocabulary file; ``package`` offers ``path(name)``. Operators take the path as a parameter."""
    return importlib.import_module(package).path(name)
