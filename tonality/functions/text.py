"""Text functions: each takes and returns a Column, so they stay inside
whole-stage codegen (no Python UDF)."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (must match the reference's behaviour).
HTTPS_URL = r"https://\S+"
BASIC_CHARS_DROP = r"[^A-Za-z0-9\s.,!?'\"-]"
NON_PRINTABLE_RUN = r"[^\x20-\x7E]+"
# Python's str.split() splits on Unicode white space and on \x1c-\x1f (trap T1).
WORD = r"(?U)[^\s\x1c-\x1f]+"
# Sentence rule: a run of non-terminators followed by its terminators.
SENTENCE = r"[^.!?]+[.!?]*"
# Word tokens with the negation clitic split off ("don't" -> "do", "n't").
TOKEN = r"n't|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
ANSWER_MARK = "Answer: "
PROMPT_TEMPLATE = (
    "Instruction: What is the sentiment of this news? Please choose an answer from "
    "{negative/neutral/positive}.\n    Input: %s\n    Answer: "
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_urls(col) -> Column:
    """Remove ``https://`` URLs (``http://`` stays)."""
    return F.regexp_replace(_c(col), HTTPS_URL, "")


def word_pattern(word: str) -> str:
    """Case-insensitive whole-word pattern with Unicode word boundaries (trap T21)."""
    return r"(?iU)\b" + re.escape(word) + r"\b"


def remove_whole_word(col, word: str = "user") -> Column:
    """Remove a whole word ignoring case; surrounding spaces are left."""
    return F.regexp_replace(_c(col), word_pattern(word), "")


def unescape_apostrophe(col) -> Column:
    """``&#39;`` -> ``'``."""
    return F.replace(_c(col), F.lit("&#39;"), F.lit("'"))


def keep_basic_chars(col) -> Column:
    """C4: keep only ASCII letters, digits, white space and . , ! ? ' \" -."""
    return F.regexp_replace(_c(col), BASIC_CHARS_DROP, "")


def keep_printable_ascii(col) -> Column:
    """Drop runs of characters outside 0x20-0x7E."""
    return F.regexp_replace(_c(col), NON_PRINTABLE_RUN, "")


def words(col) -> Column:
    """Whitespace words, Python ``split()`` semantics."""
    return F.regexp_extract_all(_c(col), F.lit(WORD), 0)


def word_count(col) -> Column:
    """Number of whitespace-separated words (0 for empty, null for null)."""
    return F.regexp_count(_c(col), F.lit(WORD)).cast("int")


def build_prompt(col, template: str = PROMPT_TEMPLATE) -> Column:
    """Wrap the text in an instruction template (``%s`` marks the text)."""
    pre, post = template.split("%s", 1)
    return F.concat(F.lit(pre), _c(col), F.lit(post))


def extract_answer(col) -> Column:
    """Text after the last ``Answer: ``, trimmed and lower-cased; else ``Error``."""
    c = _c(col)
    return (F.when(c.contains(ANSWER_MARK),
                   F.lower(F.trim(F.substring_index(c, ANSWER_MARK, -1))))
            .otherwise(F.lit("Error")))


def normalize_sentiment_text(col) -> Column:
    """Free text -> positive / negative / neutral; ``positive`` is tested first."""
    low = F.lower(_c(col))
    return (F.when(low.contains("positive"), "positive")
            .when(low.contains("negative"), "negative")
            .otherwise("neutral"))


def model_family(col) -> Column:
    """C11: model name -> family key; the order of the tests matters; unknown fails."""
    low = F.lower(_c(col))
    return (F.when(low.contains("distilroberta"), "distilRoberta")
            .when(low.contains("distilbert"), "distilBert")
            .when(low.contains("finbert"), "finBert")
            .when(low.contains("electra"), "Electra")
            .otherwise(F.raise_error(F.concat(F.lit("Model name does not match any expected keys: "),
                                              F.coalesce(_c(col), F.lit("null"))))))


def sentences(col) -> Column:
    """C12 rule: sentences as trimmed runs ending in . ! or ? (documented rule)."""
    return F.filter(F.transform(F.regexp_extract_all(_c(col), F.lit(SENTENCE), 0),
                                lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")),
                    lambda s: F.length(s) > 0)


def tokenize_words(col) -> Column:
    """Word tokens with ``n't`` split off, punctuation as own tokens."""
    spaced = F.regexp_replace(_c(col), "n't", " n't")
    return F.regexp_extract_all(spaced, F.lit(TOKEN), 0)


#: Fixed patterns: the published Penn Treebank word rules, in order, as (pattern, replacement).
TREEBANK_RULES = [
    (r'^"', "`` "), (r'([ (\[{<])"', r"\1 `` "),
    (r"([:,])([^0-9])", r" \1 \2"), (r"([:,])$", r" \1 "), (r"\.\.\.", " ... "), (r"([;@#$%&?!])", r" \1 "),
    (r"""([^.])(\.)([\])}>"']*)\s*$""", r"\1 \2\3 "), (r"([^'])' ", r"\1 ' "),
    (r"([\[\](){}<>])", r" \1 "), ("--", " -- "), (r"^|$", " "), ('"', " '' "),
    (r"([^' ])('[sSmMdD]|') ", r"\1 \2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    (r"\b([Cc]an)(not)\b", r"\1 \2"), (r"\b([Dd])('ye)\b", r"\1 \2"), (r"\b([Gg]im|[Ll]em)(me)\b", r"\1 \2"),
    (r"\b([Gg]on|[Ww]an)(na)\b", r"\1 \2"), (r"\b([Gg]ot)(ta)\b", r"\1 \2"), (r"\b([Mm]ore)('n)\b", r"\1 \2"),
    (r" ('[Tt])(is|was)\b", r" \1 \2"),
]


def treebank_tokens(col) -> Column:
    """C13 by the Treebank rules: possessives, clitics (``'ll``, ``n't``), quotes, ellipses, brackets
    and contractions become tokens of their own; a period does only at the end of the text."""
    out = _c(col)
    for pattern, replacement in TREEBANK_RULES:
        out = F.regexp_replace(out, pattern, re.sub(r"\\([0-9])", r"$\1", replacement))
    return F.regexp_extract_all(out, F.lit(r"[^ \t\n\r\f\x0b]+"), 0)


def repair_line_breaks(col) -> Column:
    """A10: line breaks inside a field -> one space; carriage returns dropped."""
    return F.regexp_replace(F.regexp_replace(_c(col), "\r", ""), "\n", " ")


def contains_keyword(col, word: str, case_sensitive: bool = True) -> Column:
    """B7 predicate: substring test, optionally case-insensitive."""
    c = _c(col)
    return c.contains(word) if case_sensitive else F.lower(c).contains(word.lower())


def matches_pattern(col, pattern: str) -> Column:
    """B8 predicate: regex search, ignoring case, Unicode classes (trap T21)."""
    return _c(col).rlike("(?iU)" + pattern)
