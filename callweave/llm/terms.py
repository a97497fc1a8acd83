"""Terms of texts: runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in order, as UTF-8; a null or empty text has none."""
    return text.encode().translate(_FOLD).split() if text else []
