"""Character classes and pattern conversion for Java regular expressions.

Python and Java disagree on what a word character, a blank and a case-blind
match are. The classes below spell out the Python meaning, so that the fixed
patterns of the lexicon keep it on the JVM.
"""

import re
import string

from pyspark.sql import functions as F

# The last entry is a letter outside the basic plane. It adds nothing to \p{L};
# its presence makes Java's lookbehind step over surrogate pairs.
LETTER = r"\p{L}" + "\U00010400"
WORD = LETTER + r"\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
# Characters that are listed are looked up in a table, and Java asks the parts of a class in turn:
# most characters are told without a look at their Unicode properties.
_ALNUM = string.ascii_letters + string.digits
NON_ALNUM = rf"[[^{_ALNUM}]&&[^\p{{L}}\p{{N}}]]"
NO_WORD = f"[[^{_ALNUM}]&&[^{WORD}]]"
NO_WORD_NOR_BLANK = f"[[^{_ALNUM} ]&&[^{WORD}]]"


def rare_class(body):
    """Java class of the characters of ``body``, none of them an ASCII letter or digit. Those are told first."""
    return f"[[^{_ALNUM}]&&[{body}]]"

# Letters that fold to i, k and s beside their own upper case.
_FOLDS = {"i": "iI\u0131\u0130", "k": "kK\u212a", "s": "sS\u017f"}
_PIECES = re.compile(r"\\b|\[\\W_\]|\(\?:|\[[^\]]*\]|[a-z]|.")


def char_class(chars):
    """Escaped body of a character class that holds exactly ``chars``."""
    return "".join(c if c.isalnum() else "\\" + c for c in chars)


def both_cases(letters):
    return "".join(_FOLDS.get(c, c + c.upper()) if c.isalpha() else c for c in letters)


def _piece(piece):
    if piece == r"\b":
        return BOUNDARY
    if piece == r"[\W_]":
        return NON_ALNUM
    if piece.startswith("["):
        return f"[{char_class(both_cases(piece[1:-1]))}]"
    if len(piece) == 1 and piece.isalpha():
        return f"[{both_cases(piece)}]"
    return piece


def _at_start(words, others):
    """Boundary test placed behind the first character of a match."""
    if not others:
        return f"(?<![{WORD}][{words}])"
    tests = []
    if words:
        tests.append(f"(?<=[{words}])(?<![{WORD}][{words}])")
    if others:
        tests.append(f"(?<=[{WORD}][{others}])")
    return tests[0] if len(tests) == 1 else "(?:" + "|".join(tests) + ")"


def _first_chars(pattern):
    first = _PIECES.findall(pattern)[1].strip("[]")
    chars = both_cases(first)
    return "".join(c for c in chars if c.isalnum()), "".join(c for c in chars if not c.isalnum())


def to_java(pattern):
    r"""Java form of a case-blind Python pattern that starts with ``\bx+``.

    The first character is consumed before its boundary is tested, so that
    Java's scan for a start compares one character and seldom looks behind.
    """
    pieces = [_piece(p) for p in _PIECES.findall(pattern)]
    first, rest = pieces[1], "".join(pieces[3:])
    words, others = _first_chars(pattern)
    return f"{first}{_at_start(char_class(words), char_class(others))}{first}*{rest}"


def any_of(patterns):
    """Java pattern that finds a match in a blank and a text iff one of ``patterns`` does in the text.

    It takes the character before a match with it, so it looks closer at the starts of words only.
    """
    starts = {}
    for pattern in patterns:
        pieces = [_piece(p) for p in _PIECES.findall(pattern)]
        starts.setdefault((_first_chars(pattern), pieces[1]), []).append("".join(pieces[3:]))

    def branch(chars, boundary, first, bodies):
        return f"[{char_class(chars)}]{boundary}{first}*(?:{'|'.join(bodies)})"

    words = [branch(w, "", first, bodies) for ((w, _), first), bodies in starts.items() if w]
    others = [branch(o, f"(?<=[{WORD}][{char_class(o)}])", first, bodies) for ((_, o), first), bodies in starts.items() if o]
    return "|".join(([f"{NO_WORD}(?:{'|'.join(words)})"] if words else []) + others)


def has_any(col, patterns):
    """Does one of ``patterns`` match in ``col``?"""
    return F.concat(F.lit(" "), col).rlike(any_of(patterns))


def _spelled(words):
    """Java pattern for any of ``words`` (lower-case), any case, as a tree of letters."""
    after = {}
    for word in words:
        after.setdefault(word[:1], set()).add(word[1:])
    parts = [f"[{c}{c.upper()}]{_spelled(after[c])}" for c in sorted(after) if c]
    if "" in after:
        parts.append("")
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def whole_words(words):
    """Java pattern for a character and then any of ``words`` (lower-case, group 1), any case, as a whole word.
    A text is given a blank before it, so that its first word has such a character too."""
    return f"{NO_WORD}({_spelled(words)})(?![{WORD}])"
