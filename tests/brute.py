"""Plain one-text-at-a-time statement of the nine steps, to test against."""

import re
import unicodedata

from decorum import lexicon as L


def leet(text):
    padded = f" {text} "
    joins = [c.isalpha() or c in L.LEET_MAP for c in padded]
    return "".join(
        L.LEET_MAP[c] if c in L.LEET_MAP and (joins[i] or joins[i + 2]) else c
        for i, c in enumerate(text)
    )


def separators(text):
    """Read single letters with something between them; three or more are joined."""
    def between(c):
        return c.isspace() or c in ".-_,;:"

    out, i = [], 0
    while i < len(text):
        letters, end, at = [], i, i
        inside = i > 0 and (text[i - 1].isalnum() or text[i - 1] == "_")
        while not inside and at < len(text) and text[at].isascii() and text[at].isalpha():
            letters.append(text[at])
            end = at = at + 1
            while at < len(text) and between(text[at]):
                at += 1
            if at == end:
                break
        if len(letters) >= 3:
            out += letters
            i = end
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def patterns(pairs):
    def run(text):
        for pattern, word in pairs:
            text = re.sub(pattern, word, text, flags=re.I)
        return text

    return run


def one_edit(word):
    """Every string one edit or adjacent swap away, over the letters that matter."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + c + b for a, b in cuts for c in letters}
    out |= {a + b[1:] for a, b in cuts if b}
    out |= {a + c + b[1:] for a, b in cuts if b for c in letters}
    out |= {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    return out - {word}


NEAR = [(w, one_edit(w)) for w in L.TOXIC_WORDS]
BY_LETTERS = {tuple(sorted(w)): w for w in L.TOXIC_WORDS}


def words(rule):
    def one(word):
        bare = word.strip(L.WORD_TRIM).lower()
        fits = 3 <= len(bare) <= 8 and bare.isalpha()
        if not fits or bare in L.TOXIC_WORDS or bare in L.SAFE_WORDS:
            return word
        # Letters outside the alphabet only matter by being different.
        return rule("".join(c if c.isascii() else "q" for c in bare)) or word

    return lambda text: " ".join(map(one, text.split()))


STEPS = {
    "nfkd": lambda t: unicodedata.normalize("NFKD", t),
    "homoglyphs": lambda t: t.translate({ord(k): v for k, v in L.HOMOGLYPHS.items()}),
    "leet": leet,
    "separators": separators,
    "repetition": lambda t: re.sub(r"(.)\1{2,}", r"\1\1", t),
    "slurs": patterns(L.SLUR_PATTERNS),
    "transpositions": patterns(L.TRANSPOSITION_PATTERNS),
    "anagrams": words(lambda b: BY_LETTERS.get(tuple(sorted(b)))),
    "near_words": words(lambda b: next((w for w, near in NEAR if b in near), None)),
}


def normalize(text):
    for step in STEPS.values():
        text = step(text)
    return text
