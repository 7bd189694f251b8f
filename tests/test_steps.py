"""The rewriting steps: worked examples, random texts, and long hostile texts."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from decorum import lexicon as L
from decorum.functions import text as T
from decorum.plans.normalize import STEPS, normalize, normalize_steps

ONE = {
    "nfkd": T.nfkd,
    "homoglyphs": T.fold_homoglyphs,
    "leet": T.reverse_leet,
    "separators": T.strip_separators,
    "repetition": T.reduce_repetition,
    "slurs": lambda c: T.match_patterns(c, L.SLUR_PATTERNS),
    "transpositions": lambda c: T.match_patterns(c, L.TRANSPOSITION_PATTERNS),
    "anagrams": T.fold_anagrams,
    "near_words": T.fold_near_words,
}

EXAMPLES = {
    "nfkd": [("ﬁ", "fi"), ("é", "é"), ("Straße", "Straße"), ("İ", "İ")],
    "homoglyphs": [("fаck", "fack"), ("ⅱ", "ii"), ("℮", "e")],
    "leet": [("@$$hole", "asshole"), ("$100", "sioo"), ("f*ck", "fck"), ("5", "5"), ("a * b", "a * b"),
             ("Hello!", "Helloi"), ("2024", "zoza")],
    "separators": [("f.u.c.k", "fuck"), ("b-i-t-c-h", "bitch"), ("f.u.c.k this company", "fuckthis company"),
                   ("a b", "a b"), ("xf.u.c", "xf.u.c")],
    "repetition": [("fuuuuuuck", "fuuck"), (".....", ".."), ("\n\n\n\n", "\n\n\n\n"), ("\r\r\r", "\r\r")],
    "slurs": [("fvck", "fuck"), ("bitvh", "bitch"), ("sh!t", "shit"), ("fuck you", "fuckyou")],
    "transpositions": [(w, "fuck") for w in ("fcuk", "fcking", "fcuked", "fcuks", "fcuking")]
    + [("siht", "shit"), ("btich", "bitch")],
    "anagrams": [("this", "this"), ("Carp,", "crap"), ("a  b\nc", "a b c"), ("", "")],
    "near_words": [("sht", "shit"), ("btch", "bitch"), ("that", "twat"), ("hello", "hell"),
                   ("where", "whore"), ("rock", "cock"), ("pass", "ass"), ("fcuk", "fuck")],
}

WHOLE = [
    ("You are an idiot", "You are an idiot"),
    ("fcuk you, John", "fuck you, John"),
    ("f@ck", "fuck"), ("f*ck", "fuck"), ("fuuuuck", "fuck"), ("@$$h0le", "asshole"),
    ("f u c k you", "fuckyou"),
    ("f.u.c.k this company", "fuckthis company"),
    ("Great job team!", "Great job teami"),
    ("You're killing it! Great presentation", "You're killing iti Great presentation"),
    ("You idiot manager, you deserve to be fired!", "You idiot manager, you deserve to be firedi"),
    ("Great teamwork on the Q3 deliverables everyone.", "Great teamwork on the Qe deliverables everyone."),
    ("I'll destroy you and this entire department!", "I'll destroy you and this entire departmenti"),
    ("Please review the attached document at your convenience.",
     "Please review the attached document at your convenience."),
    ("john@company.com", "johnacompany.com"),
    ("123-45-6789", "ize-as-gtbg"),
]


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = L.TOXIC_WORDS + L.SAFE_WORDS[:20] + [
        "fcuk", "fvck", "sh!t", "b1tch", "@$$hole", "f.u.c.k", "that", "hello", "n1gg3r", "d i e", "st*pid",
        "fcking", "ashole", "é", "ñ", "É", "ß", "ﬁ", "а", "\U0001F6A8",
        "\U00010400", "٣", "İ", "ı", "ſ", "K", "́", "½", "123-45-6789",
    ]
    blanks = [" ", "  ", "\n", ".", "-", "_", ",", "!", ";", "\t", " ", " ", "(", "'", "", ""]

    def part():
        word, kind = rng.choice(parts), rng.random()
        if kind < 0.3:
            at = rng.randrange(len(word))
            return word[:at] + rng.choice("abcehiklnorstuw@4$!10*CKé") + word[at + rng.randint(0, 1):]
        if kind < 0.4:
            return "".join(rng.sample(word, len(word)))
        if kind < 0.5:
            return word.upper()
        if kind < 0.6:
            return " ".join(word)
        return word + word[-1] * (rng.randint(1, 4) if kind < 0.65 else 0)

    return ["".join(part() + rng.choice(blanks) * rng.randint(1, 2) for _ in range(rng.randint(1, 14)))
            for _ in range(n)]


@pytest.mark.parametrize("step", STEPS)
def test_examples(apply, step):
    texts, wanted = zip(*EXAMPLES[step])
    assert apply(ONE[step], texts) == list(wanted)


@pytest.mark.parametrize("step", STEPS)
def test_step_equals_brute_force(apply, step):
    texts = random_texts(3000, step)
    assert apply(ONE[step], texts) == [brute.STEPS[step](t) for t in texts]


def test_whole_chain_examples(spark):
    rows = spark.createDataFrame(WHOLE, "text string, wanted string")
    for row in normalize(rows).collect():
        assert row.normalized == row.wanted


def test_whole_chain_equals_brute_force_and_its_steps(spark):
    texts = random_texts(3000, 7)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in normalize(df).collect():
        assert row.normalized == brute.normalize(row.text)
    for row in normalize_steps(df).collect():
        assert row.near_words == brute.normalize(row.text)


def test_result_does_not_depend_on_layout(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(300, 3)], "text string")
    one, many = (set(normalize(df.repartition(n)).collect()) for n in (1, 13))
    assert one == many


def test_steps_that_are_idempotent(apply):
    texts = random_texts(500, 5)
    for step in (T.reduce_repetition, T.fold_homoglyphs):
        once = apply(step, texts)
        assert apply(step, once) == once


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(None,), ("a",)], "text string")
    assert {r.normalized for r in normalize(df).collect()} == {None, "a"}


def test_long_hostile_texts(spark):
    """Patterns must not overflow the stack or take quadratic time."""
    n = 100_000
    texts = ["a " * n, "a." * n, "x" * n, "f" + " -" * n, "fuck " * n, "@" * n, "that " * n, "d i " * n, ".a" * n]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(len(texts))
    for row in normalize(df).collect():
        assert row.normalized == brute.normalize(row.text)


def test_distance_of_one(spark):
    pairs = [("fcuk", "fuck", True), ("fck", "fuck", True), ("fuxk", "fuck", True), ("fuck", "fuck", False),
             ("kcuf", "fuck", False), ("ab", "ba", True), ("a", "b", True), ("a", "abc", False),
             ("abcd", "badc", False), ("cufk", "fuck", False), ("fuckk", "fuck", True), ("", "a", True)]
    df = spark.createDataFrame(pairs, "a string, b string, wanted boolean")
    got = df.withColumn("near", T.osa_within_1(F.col("a"), F.col("b"))).collect()
    assert [r.near for r in got] == [r.wanted for r in got]


def test_safe_words(apply):
    assert apply(T.is_safe_word, ["THIS", "that"]) == [True, False]


def test_strict_mode_spares_plain_text(spark):
    plain = ["Hello there!", "It cost $100 in 2024.", "pass the rock to where that is", "call 123-45-6789"]
    tricks = [("f@ck", "fuck"), ("f.u.c.k", "fuck"), ("f.u.c.k this", "fuck this"), ("fuck you", "fuck you"),
              ("sh!t", "shit")]
    rows = [(t, t) for t in plain] + tricks
    df = spark.createDataFrame(rows, "text string, wanted string")
    for row in normalize(df, mode="strict").collect():
        assert row.normalized == row.wanted


def test_strict_leet_has_no_length_limit(spark, apply):
    strict = lambda c: T.reverse_leet(c, strict=True)
    texts = ["a" + "$" * n for n in (1, 63, 70, 5000)] + ["$" * 70 + "a", "$" * 70, "Hello!", "sh!t", "a!!", "4 ever", "b4", "1234"]
    got = apply(strict, texts)
    assert got == ["a" + "s" * n for n in (1, 63, 70, 5000)] + ["s" * 70 + "a", "$" * 70, "Hello!", "shit", "a!!", "4 ever", "ba", "1234"]


def test_filters_on_other_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "en", "fcuk"), (2, "de", "x")], "id long, lang string, text string").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = normalize(table).filter("lang = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert plan.count("ArrowEvalPython") <= 1


def test_nfkd_of_every_character(spark, apply):
    import unicodedata

    codes = [c for c in range(0x80, 0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    texts = [chr(c) for c in codes] + ["e" + chr(c) + "\u0301" for c in codes[::7]] + ["é" + chr(c) for c in codes]
    got = apply(T.nfkd, texts)
    assert got == [unicodedata.normalize("NFKD", t) for t in texts]


def test_nfkd_orders_marks(spark, apply):
    import unicodedata

    rng = __import__("random").Random(6)
    marks = [chr(c) for c in range(0x300, 0x30000) if unicodedata.combining(chr(c))]
    odd = [chr(c) for c in (0xAC00, 0xAC01, 0xD7A3, 0x1E69, 0x0344, 0x1F600, 0x1D160, 0x2FA1D, 0xFB2C, 0x41, 0x20, 0xA, 0xFDFA)]
    texts = ["".join(rng.choice(odd if rng.random() < 0.4 else marks) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    texts += ["q\u0307\u0323", "é\u0323", "한국어 텍스트", "x" * 50_000 + "ﬁ\u0301\u0323", None, ""]
    got = apply(T.nfkd, texts)
    assert got == [t if t is None else unicodedata.normalize("NFKD", t) for t in texts]


def test_normalize_runs_no_python(spark):
    from decorum.plans.normalize import normalize

    plan = normalize(spark.createDataFrame([("wait…",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_everyday_characters_stay_on_the_jvm(spark):
    plain = ["“quoted” – dashed", "привет мир", "漢字かな", "emoji 🎉", "naïve café — “oui”"]
    other = ["мой", "한국", "wait…", "e\u0301", "ﬁ", "ﾊﾝ"]
    df = spark.createDataFrame([(t,) for t in plain + other], "text string").select("text", T.nfkd(F.col("text")).alias("out"))
    by_mark, common, changing = T._decompositions()
    accented = "".join(c for group in by_mark.values() for c, _ in group)
    hard = F.col("text").rlike(f"[^\\x00-\\x7F](?<![{accented}{common}])(?<=[{changing}])")
    assert [r.h for r in df.select(hard.alias("h")).collect()] == [False] * len(plain) + [True] * len(other)


def test_folded_words_by_table_are_those_of_the_rule(spark, apply):
    from decorum import lexicon

    words, safe = ["naïve", "asshole", "hell", "shit"], ["shell", "hist"]
    found = T._replacements(tuple(words), tuple(safe), True, True, False)
    assert found["hall"] == "hell" and found["thsi"] == "shit" and not {"hell", "shell", "hist"} & set(found)
    rng = __import__("random").Random(9)
    others = ["".join(rng.choice("abehilostuvßï") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    texts = sorted(set(found)) + ["loashse", "naive", "naïv", "helß", "(hall)!", "HALL", "..", "a hall..b hall.", "shti", "hhell"] + others
    rule = lambda c: F.coalesce(F.when(T.in_gate(c), F.coalesce(T.anagram_word(c, words, safe), T.near_word(c, words, safe))), c)
    bare = [t for t in texts if t == t.strip(lexicon.WORD_TRIM) and t == t.lower() and " " not in t]
    assert apply(lambda c: T.fold_words(c, words, safe), bare) == apply(rule, bare)
    assert apply(lambda c: T.fold_words(c, words, safe), ["(hall)! ", "HALL", "..", "a hall..b  hall.\tok"]) == ["hell", "hell", "..", "a hall..b hell ok"]


def test_words_are_counted_as_python_does(apply):
    import re

    from decorum.functions import scores as S

    texts = ["", "a", "ab", "a b", "a bc", "ab, c_d -ef!", "naïve e\u0301te", "x\U00010400y \U00010400", "“so” … it’s", "kill, killer kill", "KILL", "a\nkill\tdie", "_kill kill_ 1kill"]
    assert apply(S.word_count, texts) == [len(re.findall(r"\w\w+", t)) for t in texts]
    hits = apply(lambda c: S.lexicon_hits(c, ["kill", "killer", "die"]), texts)
    assert hits == [len(re.findall(r"(?<!\w)(?:killer|kill|die)(?!\w)", t, re.I)) for t in texts]


def test_one_look_tells_whether_any_pattern_matches(spark):
    import re

    from decorum import lexicon
    from decorum.functions.patterns import has_any, to_java

    rng = __import__("random").Random(4)
    pieces = ["f", "u", "c", "k", "ss", "h", "i", "!", "1", "@", "a", "t", "d", "e", " ", ".", "_", "o", "l", "n", "g", "x", "\u00df", "\U00010400"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    texts += ["fcuk", "a fcuk!", "xfcuk", "fcukx", "f u c k", "x@sshole", "@sshole", "asihto", "sihts"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for patterns in (lexicon.SLUR_PATTERNS, lexicon.TRANSPOSITION_PATTERNS):
        patterns = [p for p, _ in patterns]
        one_by_one = F.lit(False)
        for p in patterns:
            one_by_one = one_by_one | F.col("text").rlike(to_java(p))
        rows = df.select("text", has_any(F.col("text"), patterns).alias("any"), one_by_one.alias("each")).collect()
        assert [r.any for r in rows] == [r.each for r in rows] and len({r.any for r in rows}) == 2
        assert all(r.any == any(re.search(p, r.text, re.I) for p in patterns) for r in rows if r.text.isascii())


def test_only_blank_ends_are_trimmed(spark, apply):
    texts = ["", " ", "a", " a", "a\u3000", "\x1f a b \u2028", None, "a b"]
    assert apply(T.strip_blanks, texts) == [t if t is None else t.strip() for t in texts]
