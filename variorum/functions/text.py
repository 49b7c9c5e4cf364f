"""Text forms, sentence segments, shingles and token estimates as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes that decide equality, location and sentence ends.
SPACE = r"\p{IsWhite_Space}"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
MARKS = r"\p{P}\p{S}"
SENTENCE_ENDS = "。！？!?；;"
CLOSING_MARKS = "”’」』》）】〕〉])\"'"

# The same white space as SPACE, for trimming without a regular expression.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

PREVIEW_CHARS = 2000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: str | Column) -> Column:
    """Trim every Unicode white space, not only U+0020."""
    return F.trim(col(c), F.lit(SPACES))


def is_blank(c: str | Column) -> Column:
    return F.coalesce(trim_space(c), F.lit("")) == ""


def visible_form(c: str | Column) -> Column:
    """White space removed; marks kept. Two readings agree when this is equal."""
    return F.regexp_replace(F.replace(col(c), F.lit(" "), F.lit("")), rf"{SPACE}+", "")


def core_form(c: str | Column) -> Column:
    """Letters and digits only. Locates a sentence; never decides agreement."""
    # Most characters are ASCII letters: those are told by one test where the three classes take three.
    return F.regexp_replace(col(c), rf"[\P{{Alnum}}&&[{SPACE}{MARKS}]]+", "")


def clean_layout(c: str | Column) -> Column:
    """Keep a white-space run as one blank only between two neighbours that are not CJK or marks."""
    glue = f"[{CJK}{MARKS}]"
    # Runs become one blank first, so scripts are looked up beside blanks only, not at every character.
    single = F.regexp_replace(trim_space(c), rf"{SPACE}(?:{SPACE}+|(?<! ))", " ")
    # Most blanks stand between ASCII letters: those are told by one test a side.
    other = r"\P{Alnum}"
    return F.regexp_replace(single, rf" (?:(?={other})(?={glue})|(?<={other} )(?<={glue} ))", "")


def sentence_end(terminators: str = SENTENCE_ENDS) -> str:
    """A terminator and the closing marks after it. Its category is tested first: one test where the set takes many."""
    kinds = "".join(sorted({rf"\p{{{unicodedata.category(t)}}}" for t in terminators}))
    return rf"[{kinds}](?<=[{re.escape(terminators)}])[{re.escape(CLOSING_MARKS)}]*"


def segments_of(c: str | Column, terminators: str = SENTENCE_ENDS) -> Column:
    """Array of sentences of a whole text, in order; empty array for blank text."""
    # Cleaning leaves no white space but blanks, so a line break can mark the cuts.
    pieces = F.split(F.regexp_replace(clean_layout(c), sentence_end(terminators), "$0\n"), "\n")
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def code_points(c: str | Column) -> Column:
    """Array of code points. Splitting at the empty pattern walks the bytes once; repeated substring() is quadratic."""
    return F.when(col(c) == "", F.array().cast("array<string>")).otherwise(F.split(col(c), ""))


def bigrams(core: str | Column) -> Column:
    """Distinct code-point bigrams of a core form."""
    points = code_points(core)
    pairs = F.zip_with(
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: F.concat(a, b),
    )
    return F.array_distinct(pairs)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once: a one-element wrapper binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def gram_codes(core: str | Column) -> Column:
    """The same bigrams, each as one number: no text is made a gram, and numbers compare faster."""
    points = F.transform(code_points(core), lambda p: F.ascii(p).cast("long"))

    def paired(points: Column) -> Column:
        last = F.greatest(F.size(points) - 1, F.lit(0))
        return F.zip_with(F.slice(points, 1, last), F.slice(points, 2, last), lambda a, b: a * 2097152 + b)

    return F.array_distinct(bound(points, paired))


def jaccard(core_a: Column, grams_a: Column, core_b: Column, grams_b: Column) -> Column:
    """Set Jaccard of bigrams; equal cores count as 1 even with one character, empty cores as 0."""

    def ratio(shared: Column) -> Column:
        return F.try_divide(shared.cast("double"), (F.size(grams_a) + F.size(grams_b) - shared).cast("double"))

    return (
        F.when((core_a == "") | (core_b == ""), 0.0)
        .when(core_a == core_b, 1.0)
        .when((F.size(grams_a) == 0) | (F.size(grams_b) == 0), 0.0)
        .otherwise(bound(F.size(F.array_intersect(grams_a, grams_b)), ratio))
    )


def similarity(a: str | Column, b: str | Column) -> Column:
    core_a, core_b = core_form(a), core_form(b)
    return jaccard(core_a, bigrams(core_a), core_b, bigrams(core_b))


def round4(c: Column) -> Column:
    """Half-up at four places on doubles, without a trip through decimals."""
    return F.floor(c * 1e4 + 0.5) / 1e4


_ASCII_RUN = r"[\x00-\x08\x0E-\x1F\x21-\x7F]+"


def estimate_tokens(c: str | Column) -> Column:
    """ceil(len/4) per maximal run of ASCII non-space characters, one per other visible character."""
    text = F.coalesce(col(c), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(_ASCII_RUN), F.lit(0))
    grouped = F.aggregate(
        runs, F.lit(0).cast("long"), lambda total, run: total + F.floor((F.char_length(run) + 3) / 4)
    )
    others = F.char_length(F.regexp_replace(text, rf"[\x00-\x7F{SPACE}]+", ""))
    return grouped + others


def token_parts(c: str | Column) -> Column:
    """What one fragment adds to a token count when fragments are later joined.

    ``whole``: every character is ASCII non-space, so the fragment only extends a run of ``lead``
    characters. Otherwise ``lead``/``trail`` are the runs touching its two ends and ``inner`` is
    final, whatever the neighbours hold.
    """
    text = F.coalesce(col(c), F.lit(""))
    lead = F.regexp_extract(text, rf"\A({_ASCII_RUN})", 1)
    whole = lead == text
    trail = F.regexp_extract(text, rf"({_ASCII_RUN})\z", 1)
    inside = F.regexp_replace(text, rf"\A{_ASCII_RUN}|{_ASCII_RUN}\z", "")
    return F.struct(
        whole.alias("whole"),
        F.char_length(lead).alias("lead"),
        F.when(whole, 0).otherwise(F.char_length(trail)).alias("trail"),
        F.when(whole, F.lit(0).cast("long")).otherwise(estimate_tokens(inside)).alias("inner"),
    )


def preview(c: str | Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.right(col(c), F.lit(chars))


def split_list(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(col(c), ","), trim_space), lambda p: p != "")


def strip_fences(c: str | Column) -> Column:
    """Drop a Markdown fence that wraps the whole answer; leave any other text as it is."""
    text = trim_space(c)
    body = F.regexp_extract(text, r"(?s)\A[^\n]*\n(.*)\z", 1)
    cut = F.regexp_replace(body, r"(?s)\A(.*)```.*\z", "$1")
    return (
        F.when(~text.startswith("```"), text)
        .when(~text.contains("\n"), "")
        .otherwise(trim_space(cut))
    )


def clean_name(name: str | Column, source_type: str | Column) -> Column:
    """Base name of an uploaded file, cut at 240 bytes, with a default per source type."""
    slashed = trim_space(F.regexp_replace(col(name), r"\\", "/"))
    base = F.substring_index(slashed, "/", -1)
    # A cut inside a multi-byte character leaves bytes that decode to nothing valid; drop them.
    whole = F.regexp_extract(base, r"(?s)\A.{0,240}", 0)
    cut = F.when(F.octet_length(base) <= 240, base).otherwise(_byte_prefix(whole, 240))
    fallback = F.when(col(source_type) == "pdf", "未命名.pdf").otherwise("未命名图片")
    return F.when(cut == "", fallback).otherwise(cut)


def _byte_prefix(text: Column, limit: int) -> Column:
    """Longest run of whole characters that fits in ``limit`` bytes."""
    zero = F.struct(F.lit(0).alias("bytes"), F.lit("").alias("text"))
    folded = F.aggregate(
        code_points(text),
        zero,
        lambda acc, ch: F.struct(
            (acc["bytes"] + F.octet_length(ch)).alias("bytes"),
            F.when(acc["bytes"] + F.octet_length(ch) <= limit, F.concat(acc["text"], ch))
            .otherwise(acc["text"])
            .alias("text"),
        ),
    )
    return folded["text"]


def document_stem(name: str | Column, default: str = "document") -> Column:
    stem = trim_space(F.regexp_replace(col(name), r"(?s)\A(.+)\.[^.]*\z", "$1"))
    return F.when(stem == "", default).otherwise(stem)


def quote_json(c: str | Column) -> Column:
    """One string as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(col(c).alias("q"))), r'(?s)\A\{"q":(.*)\}\z', 1)
