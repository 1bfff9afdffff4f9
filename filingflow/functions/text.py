"""Text predicates and scalars of the filing operators as Column functions; all stay inside Catalyst.

Regular expressions follow Unicode rules for digits and white space, as texts come in many scripts. A null text gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: terms that are never translated, in lower case.
PROTECTED_TERMS = ("rmb", "us$", "$", "ads", "class a", "class b", "nasdaq", "nyse", "sec", "us gaap", "form 20-f", "form 10-k", "cik")

#: Fixed value: patterns that mark an answer as a refusal, on lower-cased text.
REFUSALS = (
    r"\bi cannot\b",
    r"\bi can't\b",
    r"\bcannot comply\b",
    r"\bunable to assist\b",
    r"\bpolicy\b",
    "抱歉[，,]?(我)?(无法|不能)",
    "(我)?无法(协助|帮助|处理|翻译|回答)",
    "(我)?不能(协助|帮助|处理|翻译|回答)",
    "拒绝(回答|翻译|处理)",
)

#: What a refusal cannot do without: each pattern needs one of these, so that other texts are not matched against patterns.
REFUSAL_WORDS = ("i cannot", "i can't", "cannot comply", "unable to assist", "policy", "无法", "不能", "拒绝")

#: Fixed value: parts of an error that tell of a full context window, in lower case.
CONTEXT_LIMITS = ("context length", "context_length", "maximum context", "context window", "too many tokens", "token limit")

#: Fixed value: shapes of texts that are not worth a translation; each must match the whole text.
LOW_VALUE = (
    r"[\d\s,.$()%/\-–—]+",
    r"[A-Z]{1,6}",
    r"[A-Z]{1,4}-?\d{1,4}",
    r"[Ff]-?\d+",
    r"https?://\S+|www\.\S+",
    r"[^@\s]+@[^@\s]+\.[^@\s]+",
)

#: Fixed value: codes of answers whose form is wrong, and of those that another try may mend.
FORMAT_ERRORS = ("model_response_invalid", "id_validation_failed", "count_validation_failed", "empty_translation")
REPAIRABLE_ERRORS = (*FORMAT_ERRORS, "placeholder_validation_failed", "number_validation_failed", "replacement_character_validation_failed")
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: The same characters one by one.
SPACE_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, as a lambda's variable, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def stripped(text: Column) -> Column:
    """The text without white space at its ends; what lies between is not looked at."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def normalize_spaces(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def strip_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, r"</?PH_\d+>", "")


def clip(text: Column, limit: int = 160) -> Column:
    """The normalised text, cut to ``limit`` characters with three dots at the end."""
    t = normalize_spaces(text)
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def is_low_value(text: Column) -> Column:
    """Whether a text is empty, protected, of a low-value shape or without an ASCII letter."""
    shapes = r"(?U)\A(?:" + "|".join(LOW_VALUE) + r")\z"
    rules = lambda t: (t == "") | F.lower(t).isin(*PROTECTED_TERMS) | t.rlike(shapes) | ~t.rlike("[A-Za-z]")
    return once(normalize_spaces(text), rules)


def number_tokens(text: Column) -> Column:
    """The numbers of a text as strings without thousands separators, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))


def numbers_preserved(source: Column, translation: Column) -> Column:
    """Whether each number of the source stands in the translation at least as often.

    Both lists are sorted into one, in which a fold keeps how many more of a number the source has: one pass, and each list
    is made once. A source without a digit has no number to keep.
    """
    counted = lambda text, d: F.transform(number_tokens(text), lambda x: F.struct(x.alias("n"), F.lit(d).alias("d")))
    both = F.array_sort(F.concat(counted(source, 1), counted(translation, -1)))

    def step(state: Column, x: Column) -> Column:
        same = state["n"] == x["n"]
        more = F.when(same, state["d"]).otherwise(0) + x["d"]
        return F.struct(x["n"].alias("n"), more.alias("d"), (state["ok"] & (same | (state["d"] <= 0))).alias("ok"))

    start = F.struct(F.lit("").alias("n"), F.lit(0).alias("d"), F.lit(True).alias("ok"))
    kept = F.aggregate(both, start, step, lambda state: state["ok"] & (state["d"] <= 0))
    return F.when(source.rlike(r"\p{Nd}") | translation.isNull(), kept).when(source.isNotNull(), True)


def placeholder_names(text: Column) -> Column:
    """The names of well-paired placeholders, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<(PH_\d+)>.*?</\1>"), F.lit(1))


def placeholders_match(text: Column, names: Column) -> Column:
    some = F.sort_array(placeholder_names(text)) == F.sort_array(names)
    return F.when(F.contains(text, F.lit("<PH_")), some).when(text.isNotNull(), F.array_size(names) == 0)


def looks_like_refusal(text: Column) -> Column:
    """Whether a text has one of the patterns; most texts have none of their words, which are found faster."""
    some = lambda t: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in REFUSAL_WORDS])
    return once(F.lower(text), lambda t: some(t) & t.rlike("(?U)" + "|".join(f"(?:{p})" for p in REFUSALS)))


def has_replacement_character(text: Column) -> Column:
    return F.contains(text, F.lit("�"))


def is_context_limit_error(reason: Column) -> Column:
    return F.lower(reason).rlike("|".join(CONTEXT_LIMITS))


def failure_key(reason: Column) -> Column:
    return F.substring_index(reason, ":", 1)


def is_format_error(reason: Column) -> Column:
    return failure_key(reason).isin(*FORMAT_ERRORS)


def is_repairable_error(reason: Column) -> Column:
    return failure_key(reason).isin(*REPAIRABLE_ERRORS)


def json_payload(response: Column) -> Column:
    """An answer without its code fence, from the first bracket to the last one; the text itself where there is none."""
    bare = lambda t: F.when(F.startswith(t, F.lit("```")), F.regexp_replace(F.regexp_replace(t, r"(?i)\A```(?:json)?\s*", ""), r"\s*```\s*\z", "")).otherwise(t)
    inner = lambda t: once(F.regexp_extract(t, r"(?s)([\[{].*[\]}])", 1), lambda x: F.when(x != "", x).otherwise(t))
    return once(once(stripped(response), bare), inner)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.char_length(text) + 1) / 2)).cast("long")


def mask_key(key: Column) -> Column:
    """A secret for a report: nothing but its ends, or nothing at all."""
    n = F.char_length(key)
    return F.when(n == 0, "").when(n <= 6, "***").otherwise(F.concat(F.substring(key, 1, 2), F.lit("***"), F.substring(key, -2, 2)))


def duration(seconds: Column) -> Column:
    """Seconds as ``HhMMm``, ``MmSSs`` or ``Ss``; unknown if null."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), two(F.floor(s % 3600 / 60)), F.lit("m"))
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("m"), two(s % 60), F.lit("s"))
    return F.when(s.isNull(), "unknown").when(s >= 3600, hours).when(s >= 60, minutes).otherwise(F.concat(s.cast("string"), F.lit("s")))
