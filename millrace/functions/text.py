"""Text functions: Column in, Column out, all in built-in expressions, but for NFKC and the ids of characters (Arrow functions)."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.core import let

# Character vocabulary, phoneme symbols, tags, abbreviations and heading words.
CHARS = " abcdefghijklmnopqrstuvwxyz0123456789.,!?;:'\"-()[]"
IPA = "əɪʊɛæɑɔʌɜɹðθʃʒŋʤʧɚɝˈˌɐɡɾʔː\u0329ᵻ"
SPECIAL = ["<pad>", "<unk>", "<bos>", "<eos>"]
TAGS = [
    "<laugh>", "<chuckle>", "<giggle>", "<sigh>", "<cough>", "<sniffle>", "<groan>", "<yawn>", "<gasp>", "<hum>", "<breath>", "<whisper>", "<scream>", "<cry>",
    "<angry>", "<sad>", "<happy>", "<excited>", "<surprised>", "<fearful>", "<disgusted>", "<neutral>", "<calm>", "<serious>",
]
TAG = "(<[a-zA-Z_ ]+>)"
ABBREVIATIONS = {"mr.": "mister", "mrs.": "missus", "dr.": "doctor", "st.": "saint", "no.": "number", "&": " and ", "%": " percent ", "+": " plus ", "=": " equals "}
DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
HEADINGS = ["CHAPTER", "PART", "BOOK", "ACT", "SCENE", "PREFACE", "CONTENTS"]
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]
PUNCTUATION = ".,;:!?"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s{2,}|[^\S ]", " "))


def words(text: Column) -> Column:
    """Words between white space; an empty array for blank text."""
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def capital_share(ws: Column) -> Column:
    return F.size(F.filter(ws, lambda w: is_upper(F.substring(w, 1, 1)))) / F.size(ws)


def shouts(ws: Column) -> Column:
    return F.exists(ws, lambda w: is_upper(w) & (F.length(w) > 1))


def is_prose_like(text: Column) -> Column:
    """Reads like a sentence: five words or more, none in capitals, no heading word first, no roman numeral last,
    at most half of the words capitalised."""
    ws = words(text)
    last = F.upper(F.trim(F.element_at(ws, -1), F.lit(PUNCTUATION)))
    return (F.size(ws) >= 5) & ~shouts(ws) & ~F.upper(F.element_at(ws, 1)).isin(HEADINGS) & ~last.isin(ROMAN) & (capital_share(ws) <= 0.5)


def is_usable_prompt(line: Column, min_words: int = 8, max_words: int = 22) -> Column:
    """A sentence to be read out: of usable length, without words in capitals, a heading first or a roman numeral last."""

    def usable(ws: Column) -> Column:
        head = F.upper(F.trim(F.element_at(ws, 1), F.lit(PUNCTUATION)))
        return F.size(ws).between(min_words, max_words) & ~shouts(ws) & ~head.isin([*HEADINGS, "ADVENTURE"]) & (capital_share(ws) <= 0.5)

    return ~line.rlike(rf"\b({'|'.join(ROMAN)})\b\.?$") & let(words(line), usable)


# What a candidate must begin and end with, and what it must not hold.
OPENING, MARKUP, CLOSING = r"^\p{Lu}", r"[_\[\]{}]|http|Gutenberg|Copyright|CHAPTER|^Chapter", r"[.!?]$"


def stretches(text: Column) -> Column:
    """Stretches of text without line breaks up to and with . ! or ?, wherever these stand; what follows the last one is none."""
    cut = F.split(F.translate(text, "\r\n", "  "), r"(?<=[.!?])")
    return F.filter(cut, lambda s: (F.length(s) > 1) & F.right(s, F.lit(1)).isin(".", "!", "?"))


def is_expansion_candidate(text: Column, min_chars: int = 60, max_chars: int = 220) -> Column:
    """A clean prompt of 8 to 40 words: no markup, headings or front matter, few capitals, a full stop."""

    def candidate(line: Column) -> Column:
        letters = F.regexp_replace(line, r"\P{L}", "")
        spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
        capitals = let(letters, lambda x: F.length(F.regexp_replace(x, r"\P{Lu}", "")) <= 0.3 * F.greatest(F.lit(1), F.length(x)))
        return F.length(line).between(min_chars, max_chars) & spaces.between(7, 39) & line.rlike(OPENING) & line.rlike(CLOSING) & ~line.rlike(MARKUP) & capitals

    return let(squeeze(text), candidate)


def strip_markers(text: Column, start: str, end: str) -> Column:
    """What lies between the line with the start marker and the end marker; from the start or to the end without one."""
    begin = F.instr(text, start)
    body = F.when(begin > 0, F.regexp_replace(F.substr(text, F.greatest(begin, F.lit(1))), r"^[^\n]*\n?", "")).otherwise(text)
    return F.substring_index(body, end, 1)


def nfkc(text: Column) -> Column:
    """Unicode's NFKC form, by an Arrow UDF: Spark has no function for it. All text goes through a Python worker, which
    returns ASCII text as it is; a table that is known to be ASCII needs no call."""
    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")

    return form(text)


def normalize_text(text: Column, compat: bool = False, keep_tags: bool = True) -> Column:
    """Quotes and dashes unified, abbreviations and digits spelled out, other characters blanked, lower case.

    Text is brought to NFKC first. keep_tags: <tags> of letters, spaces and _ stay, in lower case, and what lies
    between them is normalised by itself; without it their marks are blanked. compat: abbreviations are replaced wherever they occur in
    this case, before lower-casing; by default only as whole words, in any case. Null stays null.
    """
    text = F.translate(nfkc(text), "\u0001\u0002", "  ")
    if not keep_tags:
        return _plain(text, compat)
    parts = F.split(F.regexp_replace(text, TAG, "\u0002$1\u0002"), "\u0002", -1)
    done = F.transform(parts, lambda part, i: F.when(i % 2 == 1, F.lower(part)).otherwise(_plain(part, compat)))
    return squeeze(F.array_join(F.filter(done, lambda part: part != ""), " "))


def _plain(text: Column, compat: bool) -> Column:
    return let(F.translate(text, "’“”", "'\"\""), lambda out: let(F.lower(out), lambda low: _spoken(out, low, compat)))


def _spoken(out: Column, low: Column, compat: bool) -> Column:
    """low: out in lower case. No replacement makes an abbreviation that wasn't there, so texts without one aren't searched for it by pattern."""
    for dash in "–—":
        out = F.replace(out, F.lit(dash), F.lit(" - "))
    for short, full in ABBREVIATIONS.items():
        if compat or not short[0].isalpha():
            out = F.replace(out, F.lit(short), F.lit(full))
        else:
            pattern = rf"(?i)(?={short[0]})(?<![\p{{L}}\p{{N}}_]){short[:-1]}\."
            out = let(out, lambda o: F.when(F.contains(low, F.lit(short)), F.regexp_replace(o, pattern, full)).otherwise(o))  # noqa: B023  called at once
    out = F.lower(out)
    # Whole numbers are spelled digit by digit: marks around them make every second part a number.
    parts = F.split(F.regexp_replace(out, r"(?=[0-9])(?<![\p{L}\p{N}_])([0-9]+)(?![\p{L}\p{N}_])", "\u0001$1\u0001"), "\u0001", -1)

    def spell(part: Column, i: Column) -> Column:
        one = part
        for d, name in enumerate(DIGITS):
            one = F.replace(one, F.lit(str(d)), F.lit(f"{name} "))
        return F.when(i % 2 == 1, F.trim(one)).otherwise(part)

    out = F.array_join(F.transform(parts, spell), "")
    return F.trim(F.regexp_replace(out, r"[^a-z0-9'\-.,!?;:()\[\]]+", " "))


def split_tags(text: Column, compat: bool = False) -> tuple[Column, Column]:
    """(normalised text without tags, the known ones among them in order and in lower case)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TAG), 1), F.lower)
    return normalize_text(F.regexp_replace(text, TAG, " "), compat, keep_tags=False), F.filter(found, lambda t: t.isin(TAGS))


def scan_tags(text: Column, tags: list[str] = TAGS) -> Column:
    """The tags that the lower-cased text contains, in the list's order."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, tags)), lambda t: F.contains(low, t))


def char_ids(text: Column, max_len: int | None = None, add_special: bool = True, phonemes: bool = False) -> Column:
    """Ids of characters; white space that has no id is passed over, other unknown characters are 1. phonemes: the
    symbols of IPA have ids as well, after the characters'."""
    first, symbols = len(SPECIAL) + len(TAGS), CHARS + (IPA if phonemes else "")
    table = np.ones(max(map(ord, symbols)) + 2, np.int32)  # the last one: any character beyond
    for i in reversed(range(len(symbols))):
        table[ord(symbols[i])] = first + i
    table[[9, 10, 11, 12, 13]] = 0

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        found, size = [np.zeros(0, np.int32)], []
        for text in texts.to_pylist():
            ids = table[np.minimum(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4"), len(table) - 1)]
            ids = ids[ids > 0]
            ids = np.concatenate([[2], ids, [3]]).astype(np.int32) if add_special else ids
            found.append(ids[:max_len] if text is not None else ids[:0])
            size.append(len(found[-1]))
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)), mask=texts.is_null())

    return run(text)


def from_char_ids(ids: Column, phonemes: bool = False) -> Column:
    """Text of ids, without pad, start and end and ids that don't exist; an unknown character reads <unk>."""
    names = [*SPECIAL, *TAGS, *CHARS, *(IPA if phonemes else "")]
    symbols = F.array(*map(F.lit, names))
    return F.array_join(F.transform(F.filter(ids, lambda i: ~i.isin(0, 2, 3) & (i < len(names))), lambda i: F.element_at(symbols, i + 1)), "")


def wer_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9' ]", " "), " +"), lambda w: w != "")


def match_key(text: Column, mode: str = "letters") -> Column:
    """letters: only a-z; alnum: a-z, digits and blanks; strip: trimmed and lower-cased."""
    low = F.lower(text)
    if mode == "letters":
        return F.regexp_replace(low, "[^a-z]", "")
    return F.regexp_replace(low, "[^a-z0-9 ]", "") if mode == "alnum" else F.trim(low)


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Edit distance of the token sequences over the reference's length; an empty reference gives 0 or 1.

    Each distinct token of the pair becomes one character, so the built-in edit distance counts tokens. There are
    characters for over a million of them.
    """
    def coded(tokens: Column, both: Column) -> Column:
        place = lambda t: F.array_position(both, t)
        code = lambda t: F.when(place(t) < 0xD800, place(t)).otherwise(place(t) + 0x800)  # noqa: E731  surrogates are no characters
        return F.array_join(F.transform(tokens, lambda t: F.decode(F.unhex(F.lpad(F.hex(code(t)), 8, "0")), "UTF-32")), "")

    def distance(p: Column) -> Column:
        edits = let(F.array_distinct(F.concat(p["a"], p["b"])), lambda both: F.levenshtein(coded(p["a"], both), coded(p["b"], both)))
        return F.when(F.size(p["a"]) == 0, F.when(F.size(p["b"]) == 0, 0.0).otherwise(1.0)).otherwise(edits / F.size(p["a"]))

    return let(F.struct(wer_tokens(ref).alias("a"), wer_tokens(hyp).alias("b")), distance)


def positional_errors(ref: Column, hyp: Column) -> tuple[Column, Column]:
    """(errors, reference words): words that differ place by place, plus the difference in length."""
    a, b = wer_tokens(ref), wer_tokens(hyp)
    n = F.least(F.size(a), F.size(b))
    differ = F.size(F.filter(F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b")), lambda p: p["a"] != p["b"]))
    return differ + F.abs(F.size(a) - F.size(b)), F.greatest(F.size(a), F.lit(1))


def average_pairwise_wer(texts: Column) -> Column:
    """Mean over all pairs of the larger of both directions; fewer than two texts give 0."""

    def mean(own: Column) -> Column:
        n = F.size(own)
        pairs = F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: F.greatest(word_error_rate(a, b), word_error_rate(b, a)))))
        return F.when(n < 2, 0.0).otherwise(let(pairs, lambda p: F.aggregate(p, F.lit(0.0), lambda x, y: x + y) / F.size(p)))

    return let(F.array_compact(texts), mean)


# Words before which a comma may be put.
CONNECTIVES = ["and", "but", "which", "while", "because", "when", "that"]


def variants(sentence: Column) -> Column:
    """Other readings of a sentence with the same words: its last mark changed, and, if it is longer than 60
    characters, a comma before the first connective after the 20th, in place of the blank before it."""
    text = F.trim(sentence)
    stem = F.regexp_replace(text, r"[.!?]$", "")
    tail = F.substr(text, F.lit(21))
    put = F.regexp_replace(tail, rf"(?s)^(.*?)\b({'|'.join(CONNECTIVES)})\b", "$1,$2")
    comma = F.replace(F.concat(F.substring(text, 1, 20), put), F.lit(" ,"), F.lit(","))
    return F.array_compact(
        F.array(
            F.when(text.endswith("."), F.concat(stem, F.lit("!"))),
            F.when(text.endswith("."), F.concat(stem, F.lit("?"))),
            F.when(text.rlike(r"[!?]$"), F.concat(stem, F.lit("."))),
            F.when((F.length(text) > 60) & (put != tail), comma),
        )
    )


def parse_mix(spec: Column) -> Column:
    """`a=.6,b` as map of weights; a name without one weighs 1."""
    pairs = F.filter(F.split(spec, ","), lambda p: F.trim(p) != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.coalesce(F.when(F.contains(p, F.lit("=")), F.substring_index(p, "=", -1).try_cast("double")), F.lit(1.0)))))


def fingerprint(col: Column, algo: str = "sha256") -> Column:
    """Hex digest of a string or binary value; for structs, maps and arrays see config_fingerprint."""
    return F.sha1(col) if algo == "sha1" else F.sha2(col, 256)


def canonical_json(col: Column) -> Column:
    """JSON text of any value under the key `v`, with the keys of all objects sorted, at every level; nulls stay. Structs and maps of the same
    content give the same text, in whatever order their fields come (variants hold their keys sorted)."""
    return F.to_json(F.parse_json(F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"})))


def config_fingerprint(col: Column) -> Column:
    """SHA-256 of the canonical JSON of a struct, map, array or plain value."""
    return F.sha2(canonical_json(col), 256)


def stable_hash(value: Column, seed: int = 0) -> Column:
    return F.crc32(F.concat(F.lit(f"{seed}:"), value.cast("string")).cast("binary"))


def parse_gate_line(line: Column) -> Column:
    """struct(step, percent) of a log line such as `[gate] step 12: ... dependence +3.4%`; null if it is none."""
    pattern = r"\[gate\] step (\d+):.*?([+-]?\d+(?:\.\d+)?)%"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).cast("long").alias("step"), F.regexp_extract(line, pattern, 2).cast("double").alias("percent")))


def dig(json: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text; a number picks from a list."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(json, f"${steps}")
