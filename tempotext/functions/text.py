"""Text and time columns. Offsets and lengths count code points; Python runs only where the JVM lacks the function."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Marks that a punctuation-free comparison leaves out.
COMPARED = r"""[\s、。，．,.!?！？:：;；'"“”‘’]"""


_LINE_END, _BLANKS = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"), re.compile("[ \t]+")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC form. Texts of ASCII only, as long in bytes as in characters, are their own and stay out of Python."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_nfkc(F.when(F.length(c) < F.octet_length(c), c)), c)


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    """NFKC and case folding, which lower() is not (sharp s becomes ss)."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Character references decoded; texts without an ampersand stay out of Python."""
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def made_once(**columns: Column) -> Column:
    """The columns as a generator's row: filters on them are not pushed below it, which would make them, and run their Python, twice."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def squeeze(c: Column) -> Column:
    """Any white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """NFKC, one space between words of a line, no empty lines."""
    lines = F.split(nfkc(c), r"\r\n|[\n\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}]")
    trimmed = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def normalized(text: str) -> str:
    """As ``normalize_text``, of one text in Python."""
    lines = (_BLANKS.sub(" ", x).strip(" ") for x in _LINE_END.split(unicodedata.normalize("NFKC", text)))
    return "\n".join(x for x in lines if x)


def term_key(c: Column) -> Column:
    return F.regexp_replace(folded(c), r"(?U)\s+", "")


def meaning_key(c: Column) -> Column:
    return squeeze(folded(c))


def compact_key(c: Column) -> Column:
    return F.translate(normalize_text(c), "\n ", "")


def coverage_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(normalize_text(c), r"(?U)[\s\W_]+", ""))


def punct_key(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + COMPARED, "")


def content_key(c: Column) -> Column:
    return F.regexp_replace(nfkc(c), r"(?U)[\s。．.]", "")


def conservation_key(c: Column) -> Column:
    return F.regexp_replace(nfkc(c), r"(?U)\s", "")


def join_pieces(pieces: Column) -> Column:
    """Trimmed pieces in a row; one space only between an ASCII word or closing mark and an ASCII word or opening mark."""

    def add(acc: Column, piece: Column) -> Column:
        gap = acc.rlike(r"[A-Za-z0-9,.!?;:)\]'\"]$") & piece.rlike(r"^[A-Za-z0-9(\['\"]")
        return F.concat(acc, F.when(gap, F.lit(" ")).otherwise(F.lit("")), piece)

    return F.aggregate(F.filter(F.transform(pieces, squeeze), lambda x: x != ""), F.lit(""), add)


def format_timestamp(ms: Column) -> Column:
    """``mm:ss.mmm``, with hours in front once there are any; negative times are zero."""
    t = F.greatest(ms, F.lit(0)).cast("long")
    h, m, s = F.expr("0").cast("long") + F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60
    tail = F.format_string("%02d:%02d.%03d", m, s, t % 1000)
    return F.when(h > 0, F.concat(F.format_string("%02d:", h), tail)).otherwise(tail)


def parse_timestamp(c: Column) -> Column:
    """Milliseconds of ``mm:ss.mmm`` or ``hh:mm:ss.mmm``; null for other texts."""
    pat = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{3})$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, pat, k), F.lit("")).cast("long"), F.lit(0))
    return F.when(c.rlike(pat), part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4))


def sanitize_filename(c: Column, most: int = 180) -> Column:
    x = F.regexp_replace(nfkc(c), r'[\\/:*?"<>|\x00-\x1f]', "_")
    x = F.regexp_replace(squeeze(x), r"^[ .]+|[ .]+$", "")
    x = F.coalesce(F.nullif(x, F.lit("")), F.lit("untitled"))
    return F.regexp_replace(F.substring(x, 1, most), r"[ .]+$", "")


def without_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", "")


def visible_text(c: Column) -> Column:
    """Inline markup to text: ``<br>`` is a line end, other tags vanish, character references are decoded."""
    return unescape(without_tags(c))


def video_key(url: Column) -> Column:
    """Video id of the known url forms, else null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*(/[^?#]*)?", 1)
    short = F.regexp_extract(path, r"^/([^/]+)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*&)?v=([^&#]+)", 1)
    inner = F.regexp_extract(path, r"^/(?:shorts|embed|live)/([^/]+)", 1)
    site = host.isin("youtube.com", "m.youtube.com")
    found = F.when(host == "youtu.be", short).when(site & (query != ""), query).when(site, inner)
    return F.nullif(found, F.lit(""))


def source_key(url: Column) -> Column:
    """Equal for urls of one source: the video id, or the trimmed url."""
    return F.coalesce(video_key(url), F.trim(url))


def has_kanji(c: Column) -> Column:
    return c.rlike(r"[㐀-鿿]")


def split_terminal_units(c: Column) -> Column:
    """Trimmed stretches of one character or more that end in a run of sentence marks, or in a full stop before white space or the end.

    One with kana or kanji on both sides of white space is cut at all white space. Loops are possessive: lines have any length.
    """
    cut = F.regexp_extract_all(c, F.lit(r"(?s).(?:[^。！？!?.]++|\.(?!\s|\z))*+(?:[。！？!?]++|\.(?=\s|\z)|\z)"), F.lit(0))
    units = F.filter(F.transform(cut, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    spaced = lambda x: x.rlike(r"(?U)[\x{3040}-\x{9fff}]\s+[\x{3040}-\x{9fff}]")
    return F.flatten(F.transform(units, lambda x: F.when(spaced(x), F.split(x, r"(?U)\s+")).otherwise(F.array(x))))


def split_reference_sentences(c: Column) -> Column:
    plain = F.regexp_replace(c, r"\[[^\]]*\]|【[^】]*】", "")
    return F.filter(F.transform(F.regexp_extract_all(plain, F.lit(r"[^。！？!?]+[。！？!?]*"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")


def split_manual_sentences(c: Column) -> Column:
    """Cut after runs of full stops and at line ends; white space inside is dropped."""
    parts = F.split(c, r"(?<=[。．.])(?![。．.])|\n")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)\s+", "")), lambda x: x != "")


def display_form(surface: Column, lemma: Column) -> Column:
    return F.when(has_kanji(surface) & ~has_kanji(lemma), surface).otherwise(lemma)


def headword(lemma: Column, reading: Column) -> Column:
    return F.when(F.coalesce(reading, F.lit("")) != "", F.concat(lemma, F.lit("（"), reading, F.lit("）"))).otherwise(lemma)


def fingerprint(*cols: Column) -> Column:
    """SHA-256 over the parts, null apart from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256)


def fenced_json(reply: Column) -> Column:
    """What lies between the first and the last brace of a reply, so fences and talk around it are ignored; null without one."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def comparable_chars(c: Column) -> Column:
    """Characters of the NFKC form without white space and marks, in order."""
    return F.filter(F.split(F.regexp_replace(nfkc(c), "(?U)" + COMPARED, ""), ""), lambda x: x != "")
