"""Markup in corpus texts: what counts as a tag, for all operators alike.

A tag is ``<`` or ``</`` with a name right behind it, attributes that have a
value or are among the bare ones of the HTML standard, and ``>``; comments and
declarations count too. A lone ``<`` or ``>`` (as in ``5 < 6``) is text, so
nothing between two of them is lost.
"""

from __future__ import annotations

import re
import unicodedata

#: Attributes that stand without a value (fixed values).
BARE = "async autofocus autoplay checked controls default defer disabled hidden ismap loop multiple muted nomodule novalidate open readonly required reversed selected"

_ATTRIBUTE = r"""\s+(?:[\w:@.-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+)|(?:%s)(?=[\s/>]))""" % "|".join(BARE.split())
TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:%s)*\s*/?>|<!--.*?-->|<![A-Za-z][^<>]*>" % _ATTRIBUTE, re.S | re.I)


def without_tags(text: str, mark: str = " ") -> str:
    """``text`` with ``mark`` in the place of every tag."""
    return TAG.sub(mark, text) if "<" in text else text


class _Plain(dict):
    """Characters by what is left of their decomposition, found when first met; a character's does not depend on its neighbours."""

    def __missing__(self, code: int) -> str:
        out = self[code] = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        return out


_PLAIN = _Plain()


def without_accents(text: str) -> str:
    """Compatibility decomposition of ``text`` without its combining marks."""
    return text if text.isascii() else text.translate(_PLAIN)
