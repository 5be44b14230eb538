"""Cleaning and element functions, all ``Column -> Column``."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from askloom.options import CleanOptions
from askloom.schemas import LIST_ITEM, NARRATIVE, TITLE

# Characters of the cleaning rules.
BULLETS = "•‣⁃◦▪●○■□–*·"
SPACES = " \t\n\r\f\x0b\u00a0"
DASHES = "-–"
TRAILING = ".,:;"

BLANK_LINE = r"\n\s*\n"
# only what differs from a single blank is matched, so plain text is not rewritten blank by blank
_UNEVEN_SPACE = f"[{SPACES}]{{2,}}|[{SPACES[1:]}]"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(SPACES))


def clean_lower(c: Column) -> Column:
    return F.lower(c)


def clean_trailing(c: Column) -> Column:
    """Without white space around and punctuation at the end."""
    return F.rtrim(strip(c), F.lit(TRAILING))


def clean_dashes(c: Column) -> Column:
    return F.translate(c, DASHES, " " * len(DASHES))


def clean_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _UNEVEN_SPACE, " "))


def clean_bullets(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BULLETS}]+[{SPACES}]*", "")


def clean(c: Column, opts: CleanOptions = CleanOptions()) -> Column:
    """All chosen cleaning steps in their fixed order."""
    if not opts.clean:
        return c
    steps = [
        (opts.lowercase, clean_lower),
        (opts.trailing_punctuation, clean_trailing),
        (opts.dashes, clean_dashes),
        (opts.extra_whitespace, clean_whitespace),
        (opts.bullets, clean_bullets),
    ]
    for wanted, step in steps:
        if wanted:
            c = step(c)
    return strip(c)


def is_blank(c: Column) -> Column:
    """True for NULL and for texts made of white space only."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def element(category: Column | str, text: Column) -> Column:
    category = F.lit(category) if isinstance(category, str) else category
    return F.struct(category.alias("category"), text.alias("text"))


def clean_elements(elements: Column, opts: CleanOptions = CleanOptions()) -> Column:
    """Clean each element of an array and drop those left without text."""
    cleaned = F.transform(elements, lambda e: element(e["category"], clean(e["text"], opts)))
    return F.filter(cleaned, lambda e: F.length(e["text"]) > 0)


def text_elements(text: Column, sep: str = BLANK_LINE) -> Column:
    """Plain text to an array of narrative elements, split at ``sep``."""
    parts = F.filter(F.transform(F.split(text, sep), strip), lambda p: F.length(p) > 0)
    return F.transform(parts, lambda p: element(NARRATIVE, p))


def heading_elements(text: Column, heading: str, sep: str = r"\n") -> Column:
    """Lines to elements; a line matching ``heading`` becomes a title without its marker."""
    parts = F.filter(F.transform(F.split(text, sep), strip), lambda p: F.length(p) > 0)
    return F.transform(
        parts,
        lambda p: element(
            F.when(p.rlike(heading), TITLE).otherwise(NARRATIVE), F.regexp_replace(p, heading, "")
        ),
    )


# Heading markers of the two outline formats.
MARKDOWN_HEADING = r"^#{1,6} +"
ORG_HEADING = r"^\*+ +"


def markdown_elements(text: Column) -> Column:
    return heading_elements(text, MARKDOWN_HEADING)


def org_elements(text: Column) -> Column:
    return heading_elements(text, ORG_HEADING)


# Markup dropped with its content, block tags that end an element.
DROPPED_TAGS = ("script", "style", "nav", "footer", "title")
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|form|"
    "h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)

# Noncharacters: Unicode keeps them for use inside a program, so no page has them as text; stray ones are dropped.
_END, _HEAD, _ITEM = "\ufdd0", "\ufdd1", "\ufdd2"


@F.pandas_udf(StringType())
def decode_references(texts: pd.Series) -> pd.Series:
    """Character references, named and numeric, to their characters."""
    return texts.map(unescape, na_action="ignore")


# The rest of a tag after its name; a quoted value may hold ">", a quote that is never closed stands for itself.
_REST = r"""(?=[\s/>])(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+>"""


def html_marked(html: Column) -> Column:
    """Page source to text in which every element starts with a marker for its category."""
    c = F.translate(html, _END + _HEAD + _ITEM, "")
    # whichever begins first hides the other: a comment in a script, a tag in a comment; an unclosed one
    # reaches to the end of the page
    dropped = rf"<({'|'.join(DROPPED_TAGS)}){_REST}.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
    c = F.regexp_replace(c, rf"(?is)<!--.*?(?:-->|\z)|{dropped}", " ")
    c = F.regexp_replace(c, rf"(?i)<h[1-6]{_REST}", _END + _HEAD)
    c = F.regexp_replace(c, rf"(?i)<li{_REST}", _END + _ITEM)
    c = F.regexp_replace(c, rf"(?i)</?(?:{BLOCK_TAGS}){_REST}", _END)
    c = F.regexp_replace(c, rf"</?[a-zA-Z][^\s/>]*+{_REST}|<[!?][^>]*>", "")
    return decode_references(c)


def html_elements(html: Column) -> Column:
    """Page source to an array of elements: headings, list items and narrative blocks."""
    parts = F.split(html_marked(html), _END)
    elements = F.transform(
        parts,
        lambda p: element(
            F.when(p.startswith(_HEAD), TITLE)
            .when(p.startswith(_ITEM), LIST_ITEM)
            .otherwise(NARRATIVE),
            strip(F.translate(p, _HEAD + _ITEM, "")),
        ),
    )
    return F.filter(elements, lambda e: F.length(e["text"]) > 0)


def split_oversized(text: Column, max_characters: int, overlap: int = 0) -> Column:
    """Pieces of at most ``max_characters``, cut after white space where there is any.

    Each piece but the first repeats the last ``overlap`` characters of the cut before it.
    """
    n = max_characters - overlap
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{n - 1}}}(?:\s|\z)|.{{1,{n}}}"), F.lit(0))
    if overlap == 0:
        return pieces
    return F.transform(
        pieces,
        lambda p, i: F.when(i == 0, p).otherwise(
            F.concat(F.right(F.try_element_at(pieces, i), F.lit(overlap)), p)
        ),
    )


def render(text: Column) -> Column:
    """Chunk text as it enters a context or preview."""
    return F.concat(text, F.lit("\n"))
