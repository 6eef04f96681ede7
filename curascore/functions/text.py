"""Label text, output parsers and report text as native columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from curascore.functions.hashing import col_of
from curascore.functions.lets import let
from curascore.settings import FALSE_PARSE

# Character classes spelt out, because shorthand classes cover different characters in different engines.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z} ]"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"

# --- fixed values: output patterns, tried in this order ---
# Groups are possessive: what follows them can never match inside them, so giving characters back cannot
# help, and the matcher then loops instead of recursing on long lines.
_PHRASE = rf"({WORD}++(?: {WORD}++)*+)"
_NAME = rf"({WORD}++)"
# Space that ends with a line break is read once and looked back on, so that long runs of line breaks stay linear.
_BREAK = rf"{SPACE}*+(?<=[\r\n])"
OUTPUT_PATTERNS = (
    rf"(?iu)(?:Class|Answer|Crop):{SPACE}*+{_PHRASE}{_BREAK}Disease:{SPACE}*+{_NAME}",
    rf"(?iu)Answer:{_BREAK}{_PHRASE}{_BREAK}{_NAME}",
    rf"(?iu)Disease:{SPACE}*+{_NAME}{_BREAK}(?:Crop|Class|Answer):{SPACE}*+{_PHRASE}",
)
CROP_LINE = rf"(?i)crop{NON_WORD}*+([a-z]++(?: [a-z]++)*+)"
DISEASE_LINE = rf"(?i)disease{NON_WORD}*+([a-z]++(?:_[a-z]++)*+)"
# The crop ends at the last word before the space in front of "Disease:"; the second form takes a crop of space only.
# The disease ends before the first bracket if the text closes with one, else it is all of the rest; written as two
# branches, so that a text with many brackets is still read once.
_CROP_WORD = r"[\p{L}\p{N}_-]++"
ZERO_SHOT = (
    rf"(?isu)^{SPACE}*+(?:Class|Crop):"
    rf"(?:{SPACE}*+(?:\*{SPACE}*+)?+({_CROP_WORD}(?:{SPACE}++(?!(?<=[\r\n])Disease:){_CROP_WORD})*+){SPACE}*+(?:\*{SPACE}*+)?+"
    rf"|(?:{SPACE}*+\*)?({SPACE})(?:{SPACE}*+\*)?+{SPACE}++)(?<=[\r\n])"
    rf"Disease:{SPACE}*\*?(?:([^(]*+)\(.*\)\*?{SPACE}*\z|(.*)\z)"
)
CLOSING_MARK = rf"(?:\*{SPACE}*+|(?<!{SPACE}){SPACE}++)\z"


def strip(c: Column | str) -> Column:
    """Remove whitespace of every kind at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(col_of(c), rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def compose_label(crop: Column | str = "crop", disease: Column | str = "disease") -> Column:
    """``lower(crop)_disease``; the disease keeps its case and inner spaces are kept."""
    return F.concat(F.lower(col_of(crop)), F.lit("_"), col_of(disease))


def cast_label(c: Column | str) -> Column:
    """Label as int; text that is no integer gives null."""
    return col_of(c).try_cast("int")


def display_text(c: Column | str) -> Column:
    return strip(F.replace(col_of(c), F.lit("_"), F.lit(" ")))


def answer_text(crop: Column | str = "crop", disease: Column | str = "disease") -> Column:
    return F.concat(F.lit("Class: "), col_of(crop), F.lit("\nDisease: "), col_of(disease))


def format_probability(c: Column | str) -> Column:
    return F.format_string("%.6f", col_of(c))


def fill_template(template: str, **values: Column) -> Column:
    """Replace ``{name}`` parts by columns, all at once, so inserted text is never searched again."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


# ---------------------------------------------------------------- output parsers

def _last_line_match(lines: Column, keyword: str, pattern: str) -> Column:
    """First match within the last line that has one; '' when no line has one."""
    hits = F.filter(lines, lambda line: F.contains(F.lower(line), F.lit(keyword)) & F.rlike(line, F.lit(pattern)))
    return F.coalesce(F.regexp_extract(F.try_element_at(hits, F.lit(-1)), pattern, 1), F.lit(""))


def parse_key_values(c: Column | str) -> Column:
    """Label from ``crop ...`` and ``disease ...`` lines anywhere in the output, else ``false_parse``."""
    return let(
        F.split(col_of(c), LINE_BREAK),
        lambda lines: let(
            F.struct(
                _last_line_match(lines, "crop", CROP_LINE).alias("crop"),
                _last_line_match(lines, "disease", DISEASE_LINE).alias("disease"),
            ),
            lambda kv: F.when(
                (kv["crop"] != "") & (kv["disease"] != ""),
                F.concat(F.lower(kv["crop"]), F.lit("_"), kv["disease"]),
            ).otherwise(F.lit(FALSE_PARSE)),
        ),
    )


def _joined(first: Column, second: Column) -> Column:
    """An underscore in the first group marks it as the disease, whatever the pattern meant."""
    return F.when(
        F.contains(first, F.lit("_")), F.concat(F.lower(second), F.lit("_"), first)
    ).otherwise(F.concat(F.lower(first), F.lit("_"), second))


def _first_pattern(out: Column, patterns: Sequence[str]) -> Column:
    """Label by the first pattern that matches, else null; a later pattern runs only where earlier ones failed."""
    if not patterns:
        return F.lit(None).cast("string")
    return let(
        F.regexp_extract(out, patterns[0], 1),
        lambda first: F.when(
            first != "", let(F.regexp_extract(out, patterns[0], 2), lambda second: _joined(first, second))
        ).otherwise(_first_pattern(out, patterns[1:])),
    )


def parse_output(c: Column | str) -> Column:
    """struct(label, is_fallback): the patterns in order, then the key-value scan.

    The fallback flag is also set when the scan fails, as failures count as both.
    """
    return let(
        col_of(c),
        lambda out: let(
            _first_pattern(out, OUTPUT_PATTERNS),
            lambda direct: F.struct(
                F.when(direct.isNotNull(), direct).when(out.isNotNull(), parse_key_values(out)).alias("label"),
                (direct.isNull() & out.isNotNull()).alias("is_fallback"),
            ),
        ),
    )


def parse_zero_shot(c: Column | str) -> Column:
    """struct(label, is_fallback) for the zero-shot answer form; the flag is never set."""
    def tidy(text: Column) -> Column:
        return F.replace(F.lower(text), F.lit(" "), F.lit("_"))

    def label(crop: Column, disease: Column) -> Column:
        bare = F.when(
            F.contains(disease, crop), F.replace(disease, F.concat(crop, F.lit(" ")), F.lit(""))
        ).otherwise(disease)
        return F.concat(tidy(crop), F.lit("_"), tidy(bare))

    def disease_part(out: Column) -> Column:
        rest = F.regexp_replace(F.regexp_extract(out, ZERO_SHOT, 4), CLOSING_MARK, "")
        return strip(F.concat(F.regexp_extract(out, ZERO_SHOT, 3), rest))  # one of the two is empty

    found = let(
        col_of(c),
        lambda out: let(
            F.concat(F.regexp_extract(out, ZERO_SHOT, 1), F.regexp_extract(out, ZERO_SHOT, 2)),
            lambda raw: F.when(
                raw != "",
                let(F.struct(strip(raw).alias("crop"), disease_part(out).alias("disease")), lambda p: label(p["crop"], p["disease"])),
            ).otherwise(F.lit(FALSE_PARSE)),
        ),
    )
    return F.struct(found.alias("label"), F.lit(False).alias("is_fallback"))


def decode_choice(output: Column | str, options: Column | str) -> Column:
    """Label behind a bare option letter, else ``false_parse``."""
    key = F.upper(strip(output))
    return F.coalesce(F.try_element_at(col_of(options), key), F.lit(FALSE_PARSE))


def first_contained(output: Column | str, labels: Sequence[str]) -> Column:
    """First label in list order that occurs in the output, else ``false_parse``.

    One search over the text: a lookahead gives, at every place where some label starts, the first such label in
    list order; few places pass the test on the leading characters. The lowest list position of these wins.
    """
    out = col_of(output)
    lead = min(4, min(len(label) for label in labels))
    gate = "|".join(re.escape(x) for x in dict.fromkeys(label[:lead] for label in labels))
    pattern = f"(?={gate})(?=({'|'.join(re.escape(label) for label in labels)}))" if lead else ""
    if not pattern:  # an empty label occurs everywhere
        hits = [F.when(F.contains(out, F.lit(label)), F.lit(label)) for label in labels]
        return F.coalesce(*hits, F.lit(FALSE_PARSE))
    listed = F.array(*[F.lit(label) for label in labels])
    return let(
        F.regexp_extract_all(out, F.lit(pattern), F.lit(1)),
        lambda hits: F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))
        .when(F.size(hits) > 1, F.get(listed, (F.array_min(F.transform(hits, lambda h: F.array_position(listed, h))) - 1).cast("int")))
        .otherwise(F.lit(FALSE_PARSE)),
    )


# ---------------------------------------------------------------- report text

_ESCAPES = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
UNPRINTABLE = r"[\p{Z}\p{C}&&[^ ]]"


def _code_escape(char: Column) -> Column:
    """``\\xNN``, ``\\uNNNN`` or ``\\UNNNNNNNN`` of one character."""
    code = F.ascii(char)
    digits = F.lower(F.hex(code.cast("bigint")))
    return (
        F.when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )


def escape_output(c: Column | str) -> Column:
    """Quoted one-line form of an output: backslash escapes, single quotes unless only those occur inside."""
    out = col_of(c)
    body = out
    for char, shown in _ESCAPES:
        body = F.replace(body, F.lit(char), F.lit(shown))

    def shown_as(body: Column) -> Column:
        # Only texts with other unprintable characters are taken apart.
        chars = F.regexp_extract_all(body, F.lit("(?s)."), F.lit(0))
        coded = F.transform(chars, lambda x: F.when(F.rlike(x, F.lit(UNPRINTABLE)), _code_escape(x)).otherwise(x))
        return F.when(F.rlike(body, F.lit(UNPRINTABLE)), F.array_join(coded, "")).otherwise(body)

    def quoted(body: Column) -> Column:
        single, double = F.contains(out, F.lit("'")), F.contains(out, F.lit('"'))
        return (
            F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
        )

    # Each step is computed once and used several times.
    return let(let(body, shown_as), quoted)


def number_text(c: Column | str) -> Column:
    """Shortest decimal text of a double: plain from 1e-4 up, ``5e-05`` style below."""
    x = col_of(c).cast("double")
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    sci = x.cast("string")
    small = F.concat(
        F.regexp_replace(F.regexp_extract(sci, r"^(-?[\d.]+)E", 1), r"\.0$", ""),
        F.lit("e-"),
        F.lpad(F.regexp_extract(sci, r"E-(\d+)$", 1), 2, "0"),
    )
    return F.when((F.abs(x) < 1e-4) & (x != 0), small).otherwise(plain)


def file_name(path: Column | str) -> Column:
    return F.substring_index(col_of(path), "/", -1)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def parse_run_name(path: Column | str, tag: str = "model_exp") -> Column:
    """struct(model, learning_rate, batch_size, experiment_id) from ``{model}_{tag}_{lr}_{batch}`` or
    ``{model}_{tag}_{id}``; ``model`` is null for any other name."""
    stem = file_stem(path)
    # --- fixed values: the two forms of run names ---
    full = rf"^([^_]+)_{re.escape(tag)}_(\d*\.?\d+(?:e-?\d+)?)_(\d+)$"
    short = rf"^([^_]+)_{re.escape(tag)}_(\d+)$"
    is_full = F.regexp_extract(stem, full, 1) != ""
    is_short = F.regexp_extract(stem, short, 1) != ""
    return F.struct(
        F.when(is_full, F.regexp_extract(stem, full, 1)).when(is_short, F.regexp_extract(stem, short, 1)).alias("model"),
        F.when(is_full, F.regexp_extract(stem, full, 2).try_cast("double")).alias("learning_rate"),
        F.when(is_full, F.regexp_extract(stem, full, 3).try_cast("int")).alias("batch_size"),
        F.when(~is_full & is_short, F.regexp_extract(stem, short, 2).try_cast("long")).alias("experiment_id"),
    )


def pretty_run_name(model: Column, batch_size: Column, learning_rate: Column, names: dict[str, str], other: str) -> Column:
    shown = F.lit(other)
    for key, text in names.items():
        shown = F.when(model == key, F.lit(text)).otherwise(shown)
    return F.concat(shown, F.lit(" Batch="), batch_size.cast("string"), F.lit(" LR="), number_text(learning_rate))
