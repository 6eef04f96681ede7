"""Output parsers: one row per branch, expectations worked out by hand."""

import random
import time

import pytest
from pyspark.sql import functions as F

from curascore.functions import text as TX
from curascore.operators.choices import context_match, resolve_prediction, with_outcome
from curascore.operators.lookup import bounded

MAIN_CASES = [
    # first pattern; only the crop is lower-cased
    ("Class: Apple\nDisease: black_rot", "apple_black_rot", False),
    ("answer: Bell Pepper \r\n\nDISEASE:   Leaf_Spot extra", "bell pepper_Leaf_Spot", False),
    ("text before Crop: CORN\nDisease: nlb\nmore", "corn_nlb", False),
    # an underscore in the crop reverses the label
    ("Class: bell_pepper\nDisease: healthy", "healthy_bell_pepper", False),
    # second pattern
    ("Answer:\nGrape\nblack_measles", "grape_black_measles", False),
    ("Answer: \n\n bell pepper\nrust", "false_parse", True),  # a space before the crop fits no pattern
    # third pattern: a one-word disease comes out reversed, one with an underscore does not
    ("Disease: rust\nCrop: Apple", "rust_Apple", False),
    ("Disease: black_rot\nClass: Apple", "apple_black_rot", False),
    # earlier patterns win
    ("Disease: scab\nCrop: Apple\nDisease: rust", "apple_rust", False),
    # key-value scan, flagged as fallback
    ('the crop = "Apple Tree"\ndisease : rust_red!', "apple tree_rust_red", True),
    ("crop = Apple\ncrop = Pear\ndisease = a\ndisease = b", "pear_b", True),  # the last matching line wins
    ("crop = Apple\ncrop = 12\ndisease = a", "apple_a", True),  # a line without a match changes nothing
    ("crops: Apple\ndisease: scab", "s_scab", True),  # letters follow the keyword at once
    ("crop: Apple disease: scab", "apple disease_scab", True),
    ("crop: Apple\u2028disease: scab", "apple_scab", True),  # every kind of line break
    ("crop: Apple\x1cdisease: scab", "apple_scab", True),
    ("crop: Apple\x0bdisease: scab", "apple_scab", True),
    ("crop: Apple", "false_parse", True),
    ("no idea", "false_parse", True),
    ("", "false_parse", True),
    # word characters of other scripts
    ("Class: Äpfel\nDisease: fäule", "äpfel_fäule", False),
]

ZERO_SHOT_CASES = [
    ("Class: Apple\nDisease: Black Rot", "apple_black_rot"),
    ("\n Crop: *Bell Pepper*\nDisease: *Leaf Spot (likely)*", "bell_pepper_leaf_spot"),
    ("Class: apple\nDisease: apple scab", "apple_scab"),  # the crop name is removed from the disease
    ("Class: Apple\nDisease: apple scab", "apple_apple_scab"),  # but only in the same case
    ("Class: Apple\nDisease: rust\nand more (see (x) y)", "apple_rust\nand_more"),
    ("The Class: Apple\nDisease: rust", "false_parse"),  # only at the start
    ("Answer: Apple\nDisease: rust", "false_parse"),
    ("Class: Apple, Disease: rust", "false_parse"),
    ("Class: Apple\nDisease:", "apple_"),
    ("Class: Apple\nDisease: rust (a) and (b)", "apple_rust"),
    ("Class: Apple\nDisease: rust (a) more", "apple_rust_(a)_more"),
    ("Class: Apple\nDisease: rust **", "apple_rust_*"),
    ("Class: Apple\nDisease: (a)", "apple_"),
    ("Class: Apple\nDisease: rust ( *", "apple_rust_("),
    ("Class: Apple\nDisease: rust ) ( ) * \n", "apple_rust_)_(_)"),
    ("Class: Apple\nDisease: rust ) ( )* \n", "apple_rust_)"),
    ("", "false_parse"),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sample_id long, output string")


def test_main_parser(spark):
    rows = frame(spark, [c[0] for c in MAIN_CASES]).select("sample_id", TX.parse_output("output").alias("p")).orderBy("sample_id").collect()
    got = [(r.p.label, r.p.is_fallback) for r in rows]
    assert got == [(c[1], c[2]) for c in MAIN_CASES]


def test_zero_shot_parser(spark):
    rows = frame(spark, [c[0] for c in ZERO_SHOT_CASES]).select("sample_id", TX.parse_zero_shot("output").alias("p")).orderBy("sample_id").collect()
    assert [r.p.label for r in rows] == [c[1] for c in ZERO_SHOT_CASES]
    assert not any(r.p.is_fallback for r in rows)


def test_long_lines_are_parsed_whole(spark):
    words = " ".join(["word"] * 30_000)
    texts = [
        f"Class: {words}\nDisease: rust", f"Answer:\n{words}\nrust", f"{words}\ncrop: Apple\n{words}\ndisease: scab {words}",
        f"Class: {words}", f"Disease: a\nCrop: {words}", "crop" + "-" * 50_000 + "1\ndisease: x",
    ]
    rows = frame(spark, texts).select("sample_id", TX.parse_output("output").alias("p")).orderBy("sample_id").collect()
    assert [r.p.label for r in rows] == [
        f"{words}_rust", f"{words}_rust", "apple_scab", "false_parse", f"a_{words}", "false_parse"]


def test_long_zero_shot_answers_are_parsed_whole(spark):
    words = " ".join(["word"] * 30_000)
    brackets = "( x " * 30_000
    texts = [f"Class: Apple\nDisease: {words} (so)", f"Class: {words}\nDisease: rust", f"Class: Apple\nDisease: {brackets}", f"Class: {words}"]
    rows = frame(spark, texts).select("sample_id", TX.parse_zero_shot("output").alias("p")).orderBy("sample_id").collect()
    under = words.replace(" ", "_")
    assert [r.p.label for r in rows] == [
        f"apple_{under}", f"{under}_rust", "apple_" + brackets.strip().replace(" ", "_"), "false_parse"]


def test_choice_and_context(spark):
    options = F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.lit("y"))
    rows = frame(spark, ["a", " B\n", "A.", "C", "\t b"]).withColumn("options", options)
    got = [r.label for r in resolve_prediction(rows, "mcq").orderBy("sample_id").collect()]
    assert got == ["x", "y", "false_parse", "false_parse", "y"]

    classes = spark.createDataFrame(
        [("apple_cedar_apple_rust", 1), ("apple_rust", 5), ("rust", 0 + 9)], "label string, list_pos int")
    texts = ["it is apple_cedar_apple_rust", "apple_rust!", "rust", "nothing", "Apple_rust"]
    got = [r.label for r in context_match(frame(spark, texts), classes).orderBy("sample_id").collect()]
    assert got == ["apple_cedar_apple_rust", "apple_rust", "rust", "false_parse", "rust"]


def test_outcomes(spark):
    vocab = bounded(spark.createDataFrame([("apple_rust", 0), ("false_parse", 1)], "label string, class_id int"))
    texts = ["Class: Apple\nDisease: rust", "crop = apple\ndisease = rust", "none", "Class: Pear\nDisease: rust"]
    rows = with_outcome(resolve_prediction(frame(spark, texts), None), vocab).orderBy("sample_id").collect()
    assert [(r.outcome, r.y_pred) for r in rows] == [("ok", 0), ("fallback", 0), ("false_parse", 1), ("out_of_vocabulary", None)]


@pytest.mark.parametrize("text", [
    "plain", "two\nlines", "it's", 'say "x"', "it's \"both\"", "tab\t", "back\\slash", "\r\n", "bell\x07", "nbsp\xa0", "soft\xad", "del\x7f", "\x85",
    "line\u2028sep", "zero\u200bwidth", "tag\U000e0001", "smile 😀 é"])
def test_escape_is_python_repr(spark, text):
    assert frame(spark, [text]).select(TX.escape_output("output").alias("e")).first().e == repr(text)


@pytest.mark.parametrize("value", [1e-4, 5e-4, 2e-4, 1e-3, 3e-3, 1e-2, 5e-5, 1.5247e-4, 1.25e-7, 1.0, 16.0, 0.5, 0.0])
def test_number_text_is_python_text(spark, value):
    assert spark.range(1).select(TX.number_text(F.lit(value)).alias("t")).first().t == str(value)


def test_strip_takes_all_whitespace(spark):
    assert frame(spark, [" \t x y\x85\n"]).select(TX.strip("output").alias("s")).first().s == "x y"


# The patterns as first written, with all their backtracking; only short texts are tried with them.
PLAIN_OUTPUT = tuple(p.format(s=TX.SPACE, w=rf"({TX.WORD}+(?: {TX.WORD}+)*)", n=rf"({TX.WORD}+)") for p in (
    r"(?iu)(?:Class|Answer|Crop):{s}*{w}{s}*[\r\n]+Disease:{s}*{n}", r"(?iu)Answer:{s}*[\r\n]+{w}{s}*[\r\n]+{n}",
    r"(?iu)Disease:{s}*{n}{s}*[\r\n]+(?:Crop|Class|Answer):{s}*{w}"))
PLAIN_ZERO_SHOT = (
    rf"(?isu)^{TX.SPACE}*(?:Class|Crop):{TX.SPACE}*\*?([\p{{L}}\p{{N}}_\t-\r\x1c-\x1f\x85\p{{Z}} -]+?)\*?{TX.SPACE}*[\r\n]+"
    rf"Disease:{TX.SPACE}*\*?(?:([^(]*+)\(.*\)\*?{TX.SPACE}*\z|(.*)\z)")


def test_patterns_equal_their_plain_forms(spark):
    rng = random.Random(4)
    parts = ["Class:", "crop:", "Answer:", "Disease:", "disease", "\n", "\n", "\r\n", " ", " ", "*", "apple", "Leaf", "_", "-", "(", ")", "x", ":"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    texts += [f"Class:{''.join(rng.choice(parts[5:14]) for _ in range(rng.randrange(0, 6)))}Disease:{''.join(rng.choice(parts) for _ in range(4))}" for _ in range(3000)]
    e = F.regexp_extract
    pairs = [F.array(*(F.array(e("output", q, 1), e("output", q, 2)) for q in patterns)) for patterns in (PLAIN_OUTPUT, TX.OUTPUT_PATTERNS)]
    zero = TX.ZERO_SHOT
    plain = F.array(TX.strip(e("output", PLAIN_ZERO_SHOT, 1)), e("output", PLAIN_ZERO_SHOT, 2), e("output", PLAIN_ZERO_SHOT, 3), F.rlike("output", F.lit(PLAIN_ZERO_SHOT)).cast("string"))
    ours = F.array(TX.strip(e("output", zero, 1)), e("output", zero, 3), e("output", zero, 4), F.rlike("output", F.lit(zero)).cast("string"))
    closing = [F.regexp_replace("output", rf"\*?{TX.SPACE}*\z", ""), F.regexp_replace("output", TX.CLOSING_MARK, "")]
    rows = frame(spark, texts).select("output", *(c.alias(n) for n, c in zip("abcdef", [*pairs, plain, ours, *closing], strict=True))).collect()
    for r in rows:
        assert r["a"] == r["b"] and r["c"] == r["d"] and r["e"] == r["f"], r["output"]


@pytest.mark.parametrize("run", ["\n", " ", "*", "\r\n", "\t"])
def test_long_runs_are_linear(spark, run):
    long = run * 10_000
    texts = [f"Class: {long}x", f"Class: a{long}x", f"Answer:{long}x", f"Class: a{long}Disease: b{long}c", f"{long}x{long}", f"Disease: a{long}b"]
    start = time.perf_counter()
    out = frame(spark, texts).select(TX.parse_output("output").alias("p"), TX.parse_zero_shot("output").alias("z"), TX.strip("output").alias("s")).collect()
    assert len(out) == len(texts) and time.perf_counter() - start < 10
