"""The nine rewriting steps that undo spelling tricks, as Column functions.

All steps are JVM expressions.
"""

import re
import string
import unicodedata
import zlib
from functools import lru_cache
from itertools import permutations

from pyspark.sql import functions as F

from decorum import lexicon
from decorum.functions.patterns import (
    BLANKS, LETTER, NO_WORD, SPACE, WORD, char_class, has_any, rare_class, to_java,
)

_NON_ASCII = r"[^\x00-\x7F]"


# ------------------------------------------------------------------ N1: NFKD

@lru_cache(maxsize=1)
def _decompositions():
    """(accented Latin-1 letters by combining mark, class of common characters that
    decomposition leaves alone, class of the characters it may change), derived from
    the Unicode tables."""
    by_mark, common, hard = {}, [], []

    def extend(ranges, code):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])

    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        parts = unicodedata.normalize("NFKD", char)
        if code < 0x100 and len(parts) == 2 and parts[0] < "\x80" and unicodedata.combining(parts[1]):
            by_mark.setdefault(parts[1], []).append((char, parts[0]))
        elif parts == char and not unicodedata.combining(char):
            extend(common, code)
        else:
            extend(hard, code)
    # Long ranges, and the alphabets and punctuation of everyday text, are tried first.
    common = [r for r in common if r[1] - r[0] > 200 or r[0] < 0x530 or 0x2000 <= r[0] < 0x2070]
    # The letter beyond the basic plane makes Java look behind by whole characters (see LETTER).
    bodies = ["\U00010400" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in ranges) for ranges in (common, hard)]
    return by_mark, *bodies


def _once(value, body):
    """``body`` of an expression that it uses more than once."""
    return F.get(F.transform(F.array(value), body), 0)


def is_ascii(col):
    return F.octet_length(col) == F.length(col)


def _replace_each(col, one, entry):
    """Every match of the pattern ``one``, a class, replaced by what the function gives for it."""
    found = F.transform(F.regexp_extract_all(col, F.lit(one), 0), entry)
    return F.array_join(F.zip_with(F.split(col, one, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _paged(table):
    """A function from a code point's Column to its entry in ``table`` (strings by code point; null
    without one). Two arrays that Spark folds to constants: the page of 64 code points, and the entries."""
    pages = sorted({code >> 6 for code in table})
    number = {page: i for i, page in enumerate(pages)}
    last = pages[-1] + 1
    index = F.split(F.lit(",".join(str(number.get(p, -1)) for p in range(last))), ",").cast("array<int>")
    entries = F.split(F.lit("\ufdd0".join(table.get((p << 6) + i, "") for p in pages for i in range(64))), "\ufdd0", -1)

    def entry(code):
        page = F.get(index, F.shiftright(code, 6))
        return F.when(page >= 0, F.nullif(F.get(entries, page * 64 + code.bitwiseAND(63)), F.lit("")))

    return entry


@lru_cache(maxsize=1)
def _tables():
    """(decompositions, combining classes) by code point, from the Unicode tables."""
    parts, classes = {}, {}
    for code in (*range(0x80, 0xAC00), *range(0xE000, 0x110000)):
        char = chr(code)
        decomposed = unicodedata.normalize("NFKD", char)
        if decomposed != char:
            parts[code] = decomposed
        if unicodedata.combining(char):
            classes[code] = str(unicodedata.combining(char))
    return parts, classes


_CHARS = "(?s)."
# The letters of Korean syllables: firsts, middles, lasts (none first).
_KOREAN = [[chr(start + i) for i in range(n)] for start, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27))]


def _decompose(col):
    """NFKD of any text: every character is replaced by its parts, and marks that follow each
    other are put in the order of their combining classes."""
    parts, classes = _tables()
    of_char, class_of = _paged(parts), _paged(classes)
    firsts, middles, lasts = (F.lit("".join(x)) for x in _KOREAN)

    def one(char):
        def by_code(code):
            at = code - 0xAC00
            syllable = F.concat(
                F.substring(firsts, (at / 588).cast("int") + 1, F.lit(1)), F.substring(middles, (at % 588 / 28).cast("int") + 1, F.lit(1)),
                F.when(at % 28 > 0, F.substring(lasts, at % 28, F.lit(1))).otherwise(""))
            return F.when(code < 0x80, char).when(at.between(0, 11171), syllable).otherwise(F.coalesce(of_char(code), char))

        return _once(F.ascii(char), by_code)

    marks = "".join(rf"\x{{{code:x}}}" for code in classes)
    run = f"[{marks}]{{2,}}"

    def ordered(marks):
        placed = F.transform(F.regexp_extract_all(marks, F.lit(_CHARS), 0), lambda c, i: F.struct(
            class_of(F.ascii(c)).cast("int").alias("class"), i.alias("at"), c.alias("char")))
        return F.array_join(F.transform(F.array_sort(placed), lambda p: p["char"]), "")

    def reordered(text):
        return F.when(text.rlike(run), _replace_each(text, run, ordered)).otherwise(text)

    return _once(_replace_each(col, _NON_ASCII, one), reordered)


def nfkd(col):
    """Unicode NFKD; the output stays decomposed.

    ASCII rows pass through. Rows in which only accented Latin-1 letters decompose (beside any
    quotes, dashes, ideographs, emoji, ...) get each such letter replaced.
    Only rows with other changing characters or combining marks are taken apart by character, with
    tables by code point, the arithmetic of Korean syllables and the order of marks.
    """
    by_mark, common, changing = _decompositions()
    whole = {char: plain + mark for mark, group in by_mark.items() for char, plain in group}
    accented = "".join(whole)
    table = F.split(F.lit(",".join(whole.get(chr(code), "") for code in range(0x80, 0x100))), ",")
    simple = _replace_each(col, f"[{accented}]", lambda c: F.get(table, F.ascii(c) - 0x80))
    hard = col.rlike(f"{_NON_ASCII}(?<![{accented}{common}])(?<=[{changing}])")
    return F.when(is_ascii(col), col).when(hard, _decompose(col)).otherwise(simple)


# ------------------------------------------------------- N2-N5: character steps

def fold_homoglyphs(col, homoglyphs=None):
    """Look-alike letters to Latin."""
    homoglyphs = homoglyphs or lexicon.HOMOGLYPHS
    single = {k: v for k, v in homoglyphs.items() if len(v) == 1}
    given = col
    for char, letters in homoglyphs.items():
        if len(letters) != 1:
            col = F.replace(col, F.lit(char), F.lit(letters))
    folded = F.translate(col, "".join(single), "".join(single.values()))
    if not all(len(char) == 1 and char > "\x7f" for char in homoglyphs):
        return folded
    # Most texts hold none.
    return F.when(~is_ascii(given) & given.rlike(rare_class("".join(homoglyphs))), folded).otherwise(given)


def reverse_leet(col, leet=None, strict=False):
    """Symbols used as letters, where a neighbour is a letter or a symbol.

    One replacement per target letter. A replaced neighbour becomes a letter, so
    the condition keeps its value along the chain; the deleted symbol goes last
    for the same reason. ``strict`` spares punctuation at the end of a word and
    numbers that stand alone.
    """
    leet = leet or lexicon.LEET_MAP
    symbol = char_class(leet)
    moved = "".join(s for s, letter in leet.items() if s != letter)
    if strict:
        return _reverse_runs(col, leet, symbol)
    left, right = f"(?<=[{LETTER}{symbol}]", f"(?=[{LETTER}{symbol}])"

    def used(symbols):
        chars = f"[{char_class(symbols)}]"
        return f"{chars}(?:{left}{chars})|{right})"

    by_letter = {}
    for char in moved:
        by_letter.setdefault(leet[char], []).append(char)
    out = col
    for letter in sorted(by_letter, key=lambda x: x == ""):
        out = F.regexp_replace(out, used(by_letter[letter]), letter)
    return F.when(col.rlike(used(moved)), out).otherwise(col)


def _reverse_runs(col, leet, symbol):
    """The strict rule, run by run: a run of symbols of any length is rewritten when
    it touches a letter. Exclamation marks that end a word are set aside first.

    Three noncharacters of Unicode mark what was set aside and the ends of a run.
    """
    aside, begin, end = "\uFDD0", "\uFDD1", "\uFDD2"
    spared = F.regexp_replace(col, f"!(?=[!?.,;:)]*+(?:[{SPACE}]|$))", aside)
    run = f"[{symbol}{aside}]"
    touching = f"(?<=[{LETTER}])({run}++)|(?<!{run})({run}++)(?=[{LETTER}])"
    marked = F.regexp_replace(spared, touching, f"{begin}$1$2{end}")
    kept = {s: letter for s, letter in leet.items() if letter}
    gone = "".join(s for s, letter in leet.items() if not letter)
    parts = F.transform(F.split(marked, f"[{begin}{end}]", -1), lambda part, i: F.when(
        i % 2 == 1, F.translate(part, "".join(kept) + gone, "".join(kept.values()))).otherwise(part))
    out = F.translate(F.array_join(parts, ""), aside, "!")
    return F.when(col.rlike(f"[{symbol}]"), out).otherwise(col)


def strip_separators(col, strict=False):
    """Join letters that were spaced out (three or more).

    Each match is one letter and the separators behind it, either at the start
    of a run (two more separated letters follow) or where the last match ended.
    The last letter of a run may begin a longer word; ``strict`` asks that the
    run ends with a whole word.
    """
    gap = rare_class(rf"{SPACE}.\-_,;:") + "+"
    end = r"(?![\p{L}\p{N}])" if strict else ""
    more = f"{gap}[a-zA-Z]{end}"
    run = f"{NO_WORD}[a-zA-Z]{more}{more}"
    start = rf"(?<![{WORD}])(?=[a-zA-Z](?:{more}){{2}})"
    joined = F.regexp_replace(
        col, rf"(?=[a-zA-Z]{gap[:-1]})(?:{start}|(?!\A)\G)([a-zA-Z]){gap}(?=[a-zA-Z]{end})", "$1"
    )
    return F.when(F.concat(F.lit(" "), col).rlike(run), joined).otherwise(col)


def reduce_repetition(col):
    """Runs of three or more of one character (not newlines) cut to two."""
    return F.regexp_replace(col, r"(?d)(.)\1{2,}", "$1$1")


# ------------------------------------------------------------ N6-N7: patterns

def match_patterns(col, patterns, strict=False):
    """Replace each pattern, in order, by its canonical word.

    A pattern that ends in optional letters also takes the gap before them;
    ``strict`` lets it do so only when a letter follows the gap.
    """
    if strict:
        optional = r"\[\\W_\]\*(\[[a-z0-9]*\]|[a-z])\*"
        patterns = [(re.sub(optional, r"(?:[\\W_]*\1+)?", p), w) for p, w in patterns]
    out = col
    for pattern, word in _merge(patterns):
        out = F.regexp_replace(out, pattern, word)
    # A row that holds none of the patterns is unchanged: one scan tells.
    return F.when(has_any(col, [p for p, _ in patterns]), out).otherwise(col)


def _merge(patterns):
    """Join neighbours with one canonical word into one alternation.

    Exact where a pattern has letters only, so that it matches whole words and
    two of them never overlap, and where none of the later ones matches the word
    that the earlier ones put in.
    """
    merged = []
    for pattern, word in patterns:
        whole = r"\W" not in pattern and not re.fullmatch(pattern, word)
        if merged and whole and merged[-1][1:] == (word, True):
            merged[-1] = (merged[-1][0] + "|" + to_java(pattern), word, True)
        else:
            merged.append((to_java(pattern), word, r"\W" not in pattern))
    return [(pattern, word) for pattern, word, _ in merged]


# --------------------------------------------------------------- N8-N11: words

def strip_blanks(col):
    """Trim Python blanks at both ends. Trimming walks through a whole text, so only texts with a blank at an end are."""
    ends = [F.contains(F.lit(BLANKS), F.substring(col, place, 1)) for place in (1, -1)]
    return F.when(ends[0] | ends[1], F.btrim(col, F.lit(BLANKS))).otherwise(col)


def single_blanks(col):
    """Words separated by one space each, as Python's ``' '.join(text.split())``."""
    blank = rare_class(SPACE)
    spaced = F.regexp_replace(col, f"(?:[[^ ]&&{blank}]| (?={blank})){blank}*", " ")
    return F.btrim(spaced, F.lit(" "))


def bare_word(word):
    """A word as it is compared: trimmed of punctuation, lower case."""
    return F.lower(F.btrim(word, F.lit(lexicon.WORD_TRIM)))


def in_gate(bare):
    """Only words of three to eight letters are compared."""
    return bare.rlike(r"^\p{L}{3,8}$")


def sorted_letters(word):
    """Anagram key: the letters in order."""
    return F.array_join(F.sort_array(F.split(word, "")), "")


def is_safe_word(col, safe=None):
    """Membership in the safe list."""
    return F.lower(col).isin(safe or lexicon.SAFE_WORDS)


def osa_within_1(a, b):
    """Is the edit distance of two words, adjacent swaps included, one?"""
    swapped = F.exists(
        F.sequence(F.lit(1), F.length(a) - 1),
        lambda i: F.concat(
            F.substring(a, 1, i - 1), F.substring(a, i + 1, F.lit(1)),
            F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)),
        ) == b,
    )
    return (F.levenshtein(a, b, 1) == 1) | (
        (F.length(a) == F.length(b)) & (F.length(a) > 1)
        & (F.levenshtein(a, b, 2) == 2) & swapped
    )


def anagram_word(bare, words=None, safe=None):
    """The lexicon word a word is an anagram of, or null."""
    words = words or lexicon.TOXIC_WORDS
    by_key = {"".join(sorted(w)): w for w in words}
    table = F.create_map(*[F.lit(x) for pair in by_key.items() for x in pair])
    found = F.try_element_at(table, sorted_letters(bare))
    return F.when(~(bare.isin(words) | is_safe_word(bare, safe)), found)


def near_word(bare, words=None, safe=None, swaps=False):
    """The first lexicon word at distance one from a word, or null.

    Without ``swaps`` it is meant for words that are no anagrams of a lexicon word:
    for those, adjacent swaps cannot occur and the plain edit distance says the same.
    """
    words = words or lexicon.TOXIC_WORDS
    near = osa_within_1 if swaps else (lambda a, b: F.levenshtein(a, b, 1) == 1)
    found = F.get(F.filter(F.array(*map(F.lit, words)), lambda w: near(bare, w)), 0)
    return F.when(~(bare.isin(words) | is_safe_word(bare, safe)), found)


def _let(value, body):
    """Compute ``value`` once inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


#: Lexicon words up to this length have all orders of their letters in the table.
SPELLED = 6


def _edits(word, swaps):
    """ASCII words at distance one, adjacent swaps included if ``swaps``."""
    halves = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    for head, tail in halves:
        yield from (head + c + tail for c in string.ascii_lowercase)
        yield from (head + c + tail[1:] for c in string.ascii_lowercase if tail)
        yield head + tail[1:]
        if swaps and len(tail) > 1:
            yield head + tail[1] + tail[0] + tail[2:]


@lru_cache(maxsize=16)
def _replacements(words, safe, anagrams, near, swaps):
    """{word: lexicon word that takes its place}, as ``anagram_word`` and ``near_word`` have it, for words of the letters a to z."""
    found = {}
    for word in words if near else ():
        for other in _edits(word, swaps):
            found.setdefault(other, word)
    if anagrams:
        for letters, word in {"".join(sorted(w)): w for w in words}.items():
            if len(letters) <= SPELLED:
                found.update(("".join(order), word) for order in permutations(letters))
    kept = {*words, *safe}
    return {w: to for w, to in found.items() if w not in kept and re.fullmatch("[a-z]{3,8}", w)}


def _rewrite_words(col, rewrite, words, safe, anagrams=False, near=False, swaps=False):
    """Replace the words that ``rewrite`` maps to something.

    The ASCII words it maps are few, and a table by their CRC-32 holds them. Other
    words, and anagrams of long lexicon words, are put through ``rewrite``.
    """
    found = _replacements(tuple(words), tuple(safe or lexicon.SAFE_WORDS), anagrams, near, swaps)
    size = 1 << max(len(found), 1).bit_length()
    slots = ["\n"] * size
    for word, to in found.items():
        slots[zlib.crc32(word.encode()) % size] += f"{word} {to}\n"
    table = F.split(F.lit("\t".join(slots)), "\t")
    long = sorted({len(w) for w in words if anagrams and SPELLED < len(w) <= 8})

    def by_table(bare):
        # No word holds a blank, so none is taken for a part of an entry.
        def entry(slot):
            key = F.concat(F.lit("\n"), bare, F.lit(" "))
            return F.when(F.contains(slot, key), F.split_part(F.split_part(slot, key, F.lit(2)), F.lit("\n"), F.lit(1)))

        slot = F.get(table, F.crc32(bare.cast("binary")).bitwiseAND(size - 1).cast("int"))
        return F.when(F.contains(slot, bare), _let(slot, entry))

    def replaced(bare):
        asked = ~is_ascii(bare)
        if long:
            asked = asked | F.length(bare).isin(long)
        return F.coalesce(F.when(F.octet_length(bare) <= 8, by_table(bare)), F.when(asked, F.when(in_gate(bare), rewrite(bare))))

    def rewritten(text):
        # All words as bare_word has them.
        trim = f"[{char_class(lexicon.WORD_TRIM)}]"
        bare = F.lower(F.regexp_replace(text, f"{trim}(?:(?<![^ ]{trim}){trim}*+|{trim}*+(?![^ ]))", ""))
        return F.array_join(F.zip_with(F.split(text, " ", -1), F.split(bare, " ", -1), lambda w, b: F.coalesce(replaced(b), w)), " ")

    return _let(single_blanks(col), rewritten)


def fold_anagrams(col, words=None, safe=None):
    """Words whose letters spell a lexicon word become that word. Blanks
    between words always become one space."""
    words = words or lexicon.TOXIC_WORDS
    return _rewrite_words(col, lambda b: anagram_word(b, words, safe), words, safe, anagrams=True)


def fold_near_words(col, words=None, safe=None):
    """N9 on its own: words one edit (or adjacent swap) from a lexicon word
    become the first such word."""
    words = words or lexicon.TOXIC_WORDS
    return _rewrite_words(col, lambda b: near_word(b, words, safe, swaps=True), words, safe, near=True, swaps=True)


def fold_words(col, words=None, safe=None):
    """N8 then N9 in one scan. A word that N8 replaces is in the lexicon, so N9
    leaves it alone; any other word reaches N9 unchanged."""
    words = words or lexicon.TOXIC_WORDS
    return _rewrite_words(
        col, lambda b: F.coalesce(anagram_word(b, words, safe), near_word(b, words, safe)),
        words, safe, anagrams=True, near=True,
    )
