"""Decoding and scripts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax_peak(logits: Column) -> Column:
    """Probability of the largest logit of an array."""
    top = F.array_max(logits)
    return 1 / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))


def argmax(logits: Column) -> Column:
    """First place (from 0) of the largest value."""
    return F.array_position(logits, F.array_max(logits)).cast("int") - 1


def ctc_path(path: Column, vocab: str, blank: int) -> Column:
    """Text of a best path: runs collapse to one, blanks go. Class k after the blank's place is character k."""
    kept = F.filter(F.transform(path, lambda c, i: F.when((i > 0) & (F.get(path, i - 1) == c), F.lit(blank)).otherwise(c)), lambda c: c != blank)
    return F.array_join(F.transform(kept, lambda c: F.substring(F.lit(vocab), F.when(c > blank, c).otherwise(c + 1), F.lit(1))), "")


def until_end(path: Column, vocab: str, end: int) -> Column:
    """Text of the classes before the first end class."""
    at = F.array_position(path, end)
    return F.array_join(F.transform(F.slice(path, F.lit(1), F.when(at > 0, at - 1).otherwise(F.size(path)).cast("int")), lambda c: F.substring(F.lit(vocab), c + 1, F.lit(1))), "")


def encode(value: Column, vocab: str) -> Column:
    """Places (from 0) of a string's characters in a vocabulary, -1 for others."""
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(vocab), c) - 1)


#: Letters of scripts written from right to left, and of all scripts.
RTL, ANY_LETTER = r"[\p{L}&&[\p{IsHebrew}\p{IsArabic}\p{IsSyriac}\p{IsThaana}\p{IsNko}]]", r"\p{L}"
#: Codes of languages written from right to left.
RTL_LANGUAGES = ("ar", "arc", "ckb", "dv", "fa", "he", "iw", "ks", "ku", "nqo", "ps", "sd", "syr", "ug", "ur", "yi")


def direction(text: Column, language: Column | None = None) -> Column:
    """rtl if letters of right-to-left scripts outnumber the others, else ltr; without letters the language decides."""
    rtl, every = F.regexp_count(text, F.lit(RTL)), F.regexp_count(text, F.lit(ANY_LETTER))
    hint = F.coalesce(F.lower(language).isin(list(RTL_LANGUAGES)), F.lit(False)) if language is not None else F.lit(False)
    return F.when(2 * rtl > every, "rtl").when((every == 0) & hint, "rtl").otherwise("ltr")


def join_overlapping(a: Column, b: Column, ratio: float) -> Column:
    """Two readings of neighbouring, overlapping crops as one text.

    The cut-off last character of ``a`` and first of ``b`` go. Of the overlaps on which both agree, the one nearest
    to the expected length wins; without one, that of the fewest differences plus the distance from it. Readings
    of at most one character are put side by side; ties go to the shorter overlap.
    """
    left, right = F.substring(a, F.lit(1), F.length(a) - 1), F.substring(b, F.lit(2), F.length(b))
    most = F.least(F.length(left), F.length(right))
    expected = F.bround(F.length(b) * F.lit(ratio)).cast("int") - 2

    def differences(k: Column) -> Column:
        tail, head = F.split(F.substring(left, F.length(left) - k + 1, k), ""), F.split(F.substring(right, F.lit(1), k), "")
        return F.size(F.filter(F.zip_with(tail, head, lambda x, y: x == y), lambda same: ~same))

    # agreement sorts before any difference, then nearness to the expected length
    costs = F.transform(F.sequence(F.lit(1), most), lambda k: F.struct((differences(k)).alias("d"), F.abs(k - expected).alias("off"), k.alias("k")))
    ranked = F.transform(costs, lambda c: F.struct((c["d"] > 0).alias("differs"), (c["d"] + c["off"]).alias("cost"), c["k"].alias("k")))
    best = F.array_min(ranked)
    merged = F.concat(left, F.substring(right, best["k"] + 1, F.length(right)))
    short = F.least(F.length(a), F.length(b)) <= 1
    apart = F.when(expected < 0, F.concat(a, b)).when(expected < 1, F.concat(left, right))
    return F.when(short, F.concat(a, b)).when(best["differs"], F.coalesce(apart, merged)).otherwise(merged)


#: Characters that Markdown text escapes.
MARKDOWN_SPECIAL = r"([\\`*_\[\]|#<>])"


def markdown_start(line: Column) -> Column:
    """A line whose start Markdown reads as plain text."""
    return F.when(F.ltrim(line).rlike(r"^([-+>#=`]|[0-9]+\.*( |$))"), F.concat(F.lit("\\"), line)).otherwise(line)


def markdown_line(line: Column) -> Column:
    """A line whose characters, and whose start, Markdown reads as plain text."""
    return markdown_start(F.regexp_replace(line, MARKDOWN_SPECIAL, r"\\$1"))


def decode(ids: Column, vocab: str) -> Column:
    """Text of places in a vocabulary; places outside it raise an error."""
    bad = F.exists(ids, lambda i: (i < 0) | (i >= len(vocab)))
    return F.when(bad, F.raise_error(F.lit("a place outside the vocabulary"))).otherwise(F.array_join(F.transform(ids, lambda i: F.substring(F.lit(vocab), i + 1, F.lit(1))), ""))


def encode_padded(value: Column, vocab: str, size: int, end: int, start: int | None = None, pad: int | None = None) -> Column:
    """``size`` places of a string: cut, or filled with ``end``, or with ``end`` and then ``pad``. A ``start`` comes
    first and pushes the last place out. Marks must lie outside the vocabulary."""
    for mark in (end, start, pad):
        if mark is not None and 0 <= mark < len(vocab):
            raise ValueError("a mark lies inside the vocabulary")
    ids = encode(value, vocab)
    if pad is not None:
        ids = F.concat(ids, F.array(F.lit(end)))
    if start is not None:
        ids = F.concat(F.array(F.lit(start)), ids)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(end if pad is None else pad), size)), 1, size)


def mean_until(peaks: Column, length: Column) -> Column:
    """Mean confidence of the steps of a word; 0 for an empty one."""
    some = F.slice(peaks, F.lit(1), length)
    return F.when(length > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / length).otherwise(F.lit(0.0))


def allow_only(logits: Column, allowed: list[int]) -> Column:
    """Logits with minus infinity for the classes that are not allowed."""
    return F.transform(logits, lambda x, i: F.when(i.isin(allowed), x).otherwise(F.lit(float("-inf"))))


def join_readings(parts: Column, ratio: float, last_ratio: float) -> Column:
    """Readings of consecutive crops as one text; the last crop overlaps by a ratio of its own."""
    n = F.size(parts)
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("t"))

    def add(a: Column, x: Column) -> Column:
        t = F.when(a["i"] == 0, x).when(a["i"] == n - 1, join_overlapping(a["t"], x, last_ratio)).otherwise(join_overlapping(a["t"], x, ratio))
        return F.struct((a["i"] + 1).alias("i"), t.alias("t"))

    return F.aggregate(parts, start, add, lambda a: a["t"])


def tile_starts(width: Column, tile: Column, step: Column) -> Column:
    """Left edges of overlapping tiles over ``width``: every ``step``, and one that ends at the right edge."""
    starts = F.sequence(F.lit(0), width - tile, step)
    return F.when(width <= tile, F.array(F.lit(0))).when(F.element_at(starts, -1) + tile < width, F.concat(starts, F.array(width - tile))).otherwise(starts)


def tiles(height: Column, width: Column, most: float = 8, target: float = 6, overlap: float = 0.5) -> Column:
    """struct(starts, tile, last_overlap) of a crop of words: one tile unless it is wider than ``most`` heights."""
    tile = F.greatest(F.lit(1), F.ceil(height * target).cast("int"))
    step = tile - F.greatest(F.lit(0), F.floor(tile * overlap).cast("int"))
    many = width / height > most
    starts = F.when(many, tile_starts(width, tile, step)).otherwise(F.array(F.lit(0)))
    n = F.size(starts)
    last = F.when(n > 1, (F.get(starts, n - 2) + tile - F.get(starts, n - 1)) / tile).otherwise(F.lit(0.0))
    return F.struct(starts.alias("starts"), F.when(many & (n > 1), tile).otherwise(width).alias("tile"), last.alias("last_overlap"))


#: Letters of Latin text and what plain ASCII writes for them.
ASCII_OF = {"À": "A", "Á": "A", "Â": "A", "Ã": "A", "Ä": "A", "Å": "A", "Æ": "AE", "Ç": "C", "È": "E", "É": "E", "Ê": "E", "Ë": "E", "Ì": "I", "Í": "I", "Î": "I", "Ï": "I", "Ñ": "N", "Ò": "O", "Ó": "O", "Ô": "O", "Õ": "O", "Ö": "O", "Ø": "O", "Ù": "U", "Ú": "U", "Û": "U", "Ü": "U", "Ý": "Y", "ß": "ss", "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "æ": "ae", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ø": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y", "ÿ": "y", "Œ": "OE", "œ": "oe", "€": "EUR", "£": "GBP", "¡": "!", "¿": "?", "«": "<<", "»": ">>", "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": "..."}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def to_ascii(text: Column) -> Column:
    """Text with the letters of ``ASCII_OF`` written in ASCII; others stay."""
    one = {a: b for a, b in ASCII_OF.items() if len(b) == 1}
    out = F.translate(text, "".join(one), "".join(one.values()))
    for a, b in ASCII_OF.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def same_text(a: Column, b: Column) -> dict[str, Column]:
    """Whether two texts are equal: as they are, without case, in ASCII, and in ASCII without case."""
    low = lambda c: F.translate(F.lower(c), UPPER, LOWER)
    return {"raw": a == b, "caseless": low(a) == low(b), "anyascii": to_ascii(a) == to_ascii(b), "unicase": low(to_ascii(a)) == low(to_ascii(b))}


def translate_vocabulary(text: Column, vocab: str, unknown: str = "■") -> Column:
    """Text in the characters of a vocabulary: white space goes, others are written in ASCII, or are ``unknown``."""
    chars = F.filter(F.split(text, ""), lambda c: (c != "") & ~c.rlike(r"^\s$"))
    inside = lambda c: F.instr(F.lit(vocab), c) > 0

    def one(c: Column) -> Column:
        plain = to_ascii(c)
        return F.when(inside(c), c).when((plain != c) & ~F.exists(F.filter(F.split(plain, ""), lambda x: x != ""), lambda x: ~inside(x)), plain).otherwise(F.lit(unknown))

    return F.array_join(F.transform(chars, one), "")


def escape_asciidoc(text: Column) -> Column:
    #: Characters that AsciiDoc text escapes.
    return F.regexp_replace(text, r"([\\`*_#^~|+{}<>])", r"\\$1")


def asciidoc_line(line: Column) -> Column:
    """A line whose start AsciiDoc reads as plain text."""
    return F.when(F.ltrim(line).rlike(r"^[=*.\-/+]"), F.concat(F.lit("{empty}"), line)).otherwise(line)


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
