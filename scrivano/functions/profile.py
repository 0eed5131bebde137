"""What a script's text operators need to know."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScriptProfile:
    """Character classes, as the inside of a regex bracket."""

    name: str
    terminators: str
    separators: str
    letters: str
    punctuation: str


_SHAD = "\\u0F0D-\\u0F11"
TIBETAN = ScriptProfile("tibetan", _SHAD, "\\u0F0B\\u0F0C", "\\u0F00-\\u0F0A\\u0F12-\\u0FFF", "\\u0F04-\\u0F14\\u0F3A-\\u0F3D")
LATIN = ScriptProfile("latin", ".!?", " ", "A-Za-z", ".,;:!?\"'()\\[\\]\\-")
#: Python's white space, which Java's \s is not.
WS = "[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B]"
EMPTY_MARKS = ("", "nan", "none", "null")
LATIN_CHARS = "A-Za-z\\x{FF21}-\\x{FF5A}"
