"""Text functions on Columns. All are null-in, null-out unless said otherwise."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that Unicode knows; \\s alone would miss the ideographic and no-break spaces.
SPACE = r"[ \t\n\x0B\f\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def normalize_text(text: Column) -> Column:
    """Lower case, runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, for which Spark has no function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def compact_for_char(text: Column) -> Column:
    """Only CJK ideographs and ASCII letters and digits."""
    return F.regexp_replace(text, r"[^一-鿿A-Za-z0-9]+", "")


#: The punctuation that normalised utterances lack.
PUNCTUATION = "，。！？、,.!?；;：:\"'“”‘’（）()《》<>-"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def strip_punctuation(text: Column, marks: str = PUNCTUATION) -> Column:
    """Without white space and the marks; letters keep their case."""
    return F.regexp_replace(text, f"[{SPACE[1:-1]}{''.join('\\' + m if m.isascii() else m for m in marks)}]+", "")


def _grams(chars: Column, n: int) -> Column:
    """All n-grams of an array of characters, in order; none if it is shorter."""
    at = F.sequence(F.lit(0), F.size(chars) - n)
    return F.when(F.size(chars) >= n, F.transform(at, lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams; a text of n characters or fewer is its own only one, an empty one has none."""

    def grams(said: Column) -> Column:
        some = let(F.split(said, ""), lambda chars: F.array_distinct(_grams(chars, n)))
        return F.when(F.length(said) == 0, F.array().cast("array<string>")).when(F.length(said) <= n, F.array(said)).when(said.isNotNull(), some)

    return let(text, grams)


def ngram_bag(text: Column, low: int, high: int, singles: Column | None = None, blocked: Column | None = None) -> Column:
    """All character n-grams of low..high, repeats kept; single characters only if listed, none that is blocked."""

    def bag(chars: Column) -> Column:
        parts = [F.filter(_grams(chars, n), lambda g: F.array_contains(singles, g)) if n == 1 and singles is not None else _grams(chars, n) for n in range(low, high + 1)]
        return F.concat(*parts)

    filled = let(F.filter(F.split(text, ""), lambda c: c != ""), bag)
    filled = F.when(text.isNotNull(), filled)
    return filled if blocked is None else F.filter(filled, lambda g: ~F.array_contains(blocked, g))


def latin_words(text: Column, least: int = 2) -> Column:
    """Runs of ASCII letters and digits of `least` characters or more, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9]{{{least},}}"), 0)


def support_tokens(text: Column) -> Column:
    """Distinct ASCII words of two characters or more, then two- and three-character runs of CJK blocks (short blocks whole)."""
    blocks = F.regexp_extract_all(text, F.lit(r"[一-鿿]+"), 0)
    grams = F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) <= 3, F.array(b)).otherwise(ngram_bag(b, 2, 3))))
    return F.array_distinct(F.concat(latin_words(text), grams))


def valid_tokens(tokens: Column, stopwords: Column, least: int = 2) -> Column:
    """Tokens that are no stopword, no number, long enough and hold a letter."""
    return F.filter(tokens, lambda t: (F.length(t) >= least) & ~F.array_contains(stopwords, t) & ~t.rlike("^[0-9]+$") & t.rlike(r"[a-z一-鿿]"))


#: Characters that aren't white space; what ends a sentence, and what ends a line.
VISIBLE, TERMINATORS = f"[^{SPACE[1:-1]}]", "。！？!?"
NEWLINES = r"\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029"


def sentence_count(text: Column, terminators: str = TERMINATORS) -> Column:
    """Parts between terminators that are not blank."""
    return F.size(F.filter(F.split(text, f"[{terminators}]+"), lambda s: s.rlike(VISIBLE))).cast("long")


def several_lines(text: Column) -> Column:
    """Whether two lines or more are not blank."""
    return F.size(F.filter(F.split(text, f"[{NEWLINES}]"), lambda s: s.rlike(VISIBLE))) > 1


def truncate(text: Column, limit: int, mark: str = "...") -> Column:
    """White space collapsed; beyond `limit` characters cut, with a mark in its place."""
    short = normalize_spaces(text)
    return F.when(F.length(short) <= limit, short).otherwise(F.concat(F.rtrim(F.substring(short, 1, limit - len(mark))), F.lit(mark)))


def normalize_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_output(text: Column) -> Column:
    """Newlines made one kind, quotes around the whole removed, lines trimmed, blank lines dropped, "a few steps" put for counts of them."""
    lined = F.regexp_replace(F.trim(text), "\r\n?", "\n")
    bare = F.regexp_replace(lined, '(?s)^"(.*)"$', "$1")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.regexp_replace(F.array_join(lines, "\n"), r"\b(?:two|three|[2-9]) steps\b", "a few steps")


def strip_tags(text: Column) -> Column:
    """Scripts, styles and tags replaced by spaces, entities of brackets and ampersands restored, spaces collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " "), "(?s)<[^>]*>", " ")
    plain = F.replace(F.replace(F.replace(bare, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(plain, "[ \t\n\r]+", " "))


TAG = r"\[([a-z_]+)\]"


def tag_sequence(text: Column) -> Column:
    """Names of inline [tags], in order."""
    return F.regexp_extract_all(text, F.lit(TAG), 1)


def tag_segments(text: Column) -> Column:
    """(strategy, text) of each tag and what stands between it and the next, trimmed; empty ones dropped."""
    texts = F.slice(F.split(text, TAG, -1), 2, F.greatest(F.size(F.split(text, TAG, -1)) - 1, F.lit(0)))
    pairs = F.zip_with(tag_sequence(text), texts, lambda s, t: F.struct(s.alias("strategy"), F.trim(t).alias("text")))
    return F.filter(pairs, lambda p: p["text"] != "")


def compress_sequence(items: Column, drop: str, most: int = 6) -> Column:
    """`drop` removed, then neighbours that are equal made one, then at most `most`."""
    return let(F.filter(items, lambda x: x != drop), lambda a: F.slice(F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))), 1, most))


def select_fragments(segments: Column, blocked: list[str], least: int = 8, most: int = 3) -> Column:
    """The first usable segment of each strategy, in order: long enough, nothing blocked in it."""
    good = F.filter(segments, lambda s: (F.length(s["text"]) >= least) & ~F.exists(F.array(*map(F.lit, blocked)), lambda b: F.contains(s["text"], b)))
    names = let(good, lambda g: F.transform(g, lambda s: s["strategy"]))
    return let(F.struct(good.alias("g"), names.alias("n")), lambda x: F.slice(F.filter(x["g"], lambda s, i: F.array_position(x["n"], s["strategy"]) == i + 1), 1, most))


def extract_json(text: Column) -> Column:
    """From the first { to the last }; empty if there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def hits(text: Column, probes: list[str]) -> Column:
    """The probes that text contains, in the probes' order."""
    return F.filter(F.array(*map(F.lit, probes)), lambda p: F.contains(text, p))


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.greatest(F.length(part), F.lit(1))).cast("long")


def rationale(text: Column, mode: str, boilerplate: str = "") -> Column:
    """Sentences of a rationale: 'last', 'filtered' (those without boilerplate), 'all' or 'none'; joined by spaces."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda x: F.trim(x)), lambda s: s != "")
    if mode == "none":
        return F.lit("")
    if mode == "last":
        return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    if mode == "filtered":
        parts = F.filter(parts, lambda s: ~s.rlike(boilerplate))
    elif mode != "all":
        raise ValueError(f"unknown mode {mode}")
    return F.array_join(parts, " ")


def path_labels(path: Column, names: dict[str, str]) -> Column:
    """Labels along an a->b path; unknown steps stay."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.array_join(F.transform(F.split(path, "->"), lambda s: F.coalesce(F.element_at(table, F.trim(s)), F.trim(s))), "->")


def hash16(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def sample_id(run_id: Column, index: Column) -> Column:
    """Last eight letters and digits of the run, and the index in four digits."""
    return F.concat(F.right(F.regexp_replace(run_id, "[^A-Za-z0-9]", ""), F.lit(8)), F.lit("-"), F.lpad(index.cast("string"), 4, "0"))


def fixed3(x: Column) -> Column:
    return F.format_string("%.3f", x)


def stable_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON: keys sorted, nulls kept, a space after commas and colons, no other escapes than JSON needs."""
    items = [F.concat(F.lit(f"{json.dumps(k, ensure_ascii=False)}: "), json_text(fields[k])) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}")), 256)


def json_text(value: Column) -> Column:
    """A column as JSON text: strings quoted, numbers and booleans bare, null for null."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("x")), {"ignoreNullFields": "false"}), r"(?s)^\{\"x\":(.*)\}$", 1)


def bundle_hash(rows: DataFrame, by: list[str], label: str, text: str, head: str = "") -> DataFrame:
    """by.., bundle: SHA-256 of `head` and each label with its text, a line each, in order of labels. A bundle is a few prompts."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(label, text))), lambda x: F.concat(x[label], F.lit("\n"), x[text]))
    return rows.groupBy(*by).agg(F.sha2(F.concat_ws("\n", F.lit(head), F.array_join(parts, "\n")), 256).alias("bundle"))
