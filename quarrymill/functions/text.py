"""Column expressions on text. Lengths and positions count Unicode code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Unicode counts as white space, as a regex class that Java and RE2 read alike.
BLANK = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The Han ranges whose runs become two-character terms.
HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def one_spaced(text: Column) -> Column:
    """Lower case, without outer white space, every inner run of it as one blank."""
    return strip(F.regexp_replace(F.lower(text), f"{BLANK}+", " "))


def squeezed(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), f"{BLANK}+", "")


def terms(text: Column) -> Column:
    """Search terms in order: adjacent pairs of each Han run, other letter and digit runs in lower case, each run by itself.

    A Han run of one character gives no term; null gives null.
    """
    runs = F.regexp_extract_all(text, F.lit(rf"{HAN}+|[\p{{L}}\p{{N}}&&[^{HAN[1:]}]+"), F.lit(0))

    def of_run(run: Column) -> Column:
        first = F.ascii(run)
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        none = F.array().cast("array<string>")
        return F.when(~first.between(0x3400, 0x9FFF), F.array(F.lower(run))).when(F.length(run) < 2, none).otherwise(pairs)

    # Lower case changes where a run ends, or depends on its neighbours, with a dotted capital I and a sigma only.
    plain = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.when(text.rlike(rf"{HAN}|[\x{{130}}\x{{3A3}}]"), F.flatten(F.transform(runs, of_run))).otherwise(plain)


def plain_markdown(text: Column) -> Column:
    """Without images, links as their text, no more than one empty line in a row, and stripped.

    An image stands on one line, and may have brackets in its description; a link's address stands on one line.
    """
    # What counts as an image and as a link.
    bare = F.regexp_replace(text, r"!\[[^\n]*?\]\([^\n]*?\)", "")
    linked = F.regexp_replace(bare, r"\[([^\]]*)\]\([^\n]*?\)", "$1")
    return strip(F.regexp_replace(linked, r"\n{3,}", "\n\n"))


def token_estimate(text: Column) -> Column:
    """A third of the UTF-8 bytes, at least 1; 0 for the empty text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.octet_length(text) / 3).cast("int")))


def slug(text: Column, longest: int = 30) -> Column:
    """The first line, 80 characters at most, in lower case with runs of other than word characters as one dash."""
    line = F.left(F.split(strip(text), "\n", 2)[0], F.lit(80))
    return F.left(F.btrim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}_]+", "-"), F.lit("-")), F.lit(longest))


def session_date(stem: Column) -> Column:
    """The date a session's file name begins with, or an empty text."""
    return F.when(stem.rlike(r"^\d{4}-\d{2}-\d{2}-.+-\d{6}$") | (F.length(stem) >= 10) & stem.rlike(r"^\d{4}-"), F.left(stem, F.lit(10))).otherwise("")


def session_slug(stem: Column) -> Column:
    """What a session's file name says between date and time; the whole name if it has no date."""
    full = F.regexp_extract(stem, r"^\d{4}-\d{2}-\d{2}-(.+)-\d{6}$", 1)
    return F.when(full != "", full).when((F.length(stem) >= 10) & stem.rlike(r"^\d{4}-"), F.substring(stem, 12, 1 << 30)).otherwise(stem)


def piece_of_context(source: Column, text: Column) -> Column:
    # Fixed value: the label before a source.
    return F.concat(F.lit("[来源: "), source, F.lit("]\n"), text)
