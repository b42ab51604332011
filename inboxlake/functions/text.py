"""Message-text column functions.

All of them are native Spark expressions (Java regex inside whole-stage
codegen) except HTML entity decoding, which is an Arrow pandas UDF that only
receives rows that contain an ``&`` (other rows are passed as null and cost
nothing on the Python side).  Patterns avoid look-around and back-references
so the same expressions run unchanged on RE2 engines.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import php_trim

_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _decode(s: str | None) -> str | None:
    if s is None:
        return None
    return _ENTITY.sub(lambda m: html.unescape(m.group(0)), s)


def _decode_series(s: pd.Series) -> pd.Series:
    return s.map(_decode, na_action="ignore")


_UDFS: dict = {}


def _udf(name: str, fn, ret: str):
    """Create Arrow UDFs lazily on the driver (workers import this module without a session)."""
    if name not in _UDFS:
        _UDFS[name] = F.pandas_udf(fn, ret)
    return _UDFS[name]


# ---- fixed values: entities decoded natively (all others go to the Python decoder) ----
COMMON_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
                   ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]
# ---------------------------------------------------------------------------------------
_OTHER_ENTITY = (r"&(?!(?:lt|gt|quot|apos|#39|nbsp|copy|middot|amp);)"
                 r"(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _decode_common(col: Column) -> Column:
    # '&amp;' last: no replacement re-introduces '&' or a name character, so the
    # chain equals one left-to-right pass ('&amp;lt;' -> '&lt;', not '<')
    for ent, ch in COMMON_ENTITIES:
        col = F.replace(col, F.lit(ent), F.lit(ch))
    return col


def decode_entities(col: Column) -> Column:
    """HTML entity decoding (named HTML5, decimal, hex; a terminating ';' is required).

    Texts whose entities are all in ``COMMON_ENTITIES`` are decoded natively;
    only texts with another entity are sent to the Python decoder.
    """
    dec = _udf("decode", _decode_series, "string")
    return F.coalesce(dec(F.when(col.rlike(_OTHER_ENTITY), col)), _decode_common(col))


def sender_domain(addr: Column) -> Column:
    """lower-cased text after the last '@'; '' when there is no '@'."""
    return F.when(F.instr(addr, "@") > 0, F.lower(F.substring_index(addr, "@", -1))).otherwise(F.lit(""))


def resolve_thread_id(references: Column, message_id: Column, uid: Column) -> Column:
    """first ``<...>`` of References; else the message id; else the uid."""
    first_ref = F.regexp_extract(references, r"<([^>]+)>", 1)
    fallback = F.coalesce(message_id, uid.cast("string"))
    has_refs = F.coalesce(references, F.lit("")) != ""
    return F.when(has_refs & (first_ref != ""), first_ref).otherwise(fallback)


def labels_from_flags(flags: Column) -> Column:
    """['INBOX'] plus 'IMPORTANT' when the \\FLAGGED flag is present (any case)."""
    flagged = F.exists(F.coalesce(flags, F.array().cast("array<string>")),
                       lambda f: F.upper(f) == F.lit("\\FLAGGED"))
    return F.when(flagged, F.array(F.lit("INBOX"), F.lit("IMPORTANT"))).otherwise(F.array(F.lit("INBOX")))


# fixed values: patterns that must match the same lines
QUOTE_PATTERNS = [r"^On .+ wrote:$", r"(?i)^-{2,}\s*Original Message\s*-{2,}"]


def strip_quoted_replies(text: Column) -> Column:
    """cut at the first line that, trimmed, is an attribution line, an
    'Original Message' separator or starts with '>'; trim the rest."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def is_quote(line: Column) -> Column:
        t = php_trim(line)
        cond = t.startswith(">")
        for p in QUOTE_PATTERNS:
            cond = cond | t.rlike(p)
        return cond

    pos = F.array_position(F.transform(lines, is_quote), True)
    kept = F.when(pos > 0, F.slice(lines, 1, pos - 1)).otherwise(lines)
    return php_trim(F.array_join(kept, "\n"))


def collapse_whitespace(text: Column) -> Column:
    """F5 without decoding: trailing blanks per line, 3+ newlines -> 2, blank runs -> 1, trim."""
    t = F.regexp_replace(text, r"[ \t]+(\n|\z)", "$1")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return php_trim(t)


def normalize_whitespace(text: Column) -> Column:
    """decode HTML entities, then collapse whitespace."""
    return collapse_whitespace(decode_entities(text))


def strip_tags(text: Column) -> Column:
    """remove tags; like PHP, '<' followed by a blank is text, an unclosed tag runs to the end."""
    return F.regexp_replace(text, r"<(?:[^\s>][^>]*)?(?:>|\z)", "")


_BLOCK_TAGS = "p|div|h[1-6]|li|ul|ol|tr|table|thead|tbody|article|section|nav|header|footer|title|blockquote|head|body|html|pre|main|aside"


def html_to_text(html_col: Column) -> Column:
    """drop comments, <style> and <script> blocks, turn line-level tags into
    line breaks, drop every other tag.  Text equality is the goal, not markup."""
    h = F.regexp_replace(html_col, r"(?s)<!--.*?-->", "")
    h = F.regexp_replace(h, r"(?is)<style\b[^>]*>.*?</style>", "")
    h = F.regexp_replace(h, r"(?is)<script\b[^>]*>.*?</script>", "")
    h = F.regexp_replace(h, r"(?i)<br\s*/?>", "\n")
    h = F.regexp_replace(h, rf"(?i)</?(?:{_BLOCK_TAGS})\b[^>]*>", "\n")
    h = F.regexp_replace(h, r"(?i)</?(?:td|th)\b[^>]*>", " ")
    return F.regexp_replace(h, r"<[^>]*>", "")


def clean_body(plain: Column, html_col: Column | None = None) -> Column:
    """F4-F7 as the ingest applies them: HTML is only used when the plain part is
    empty; then quotes are cut, whitespace normalised, and tags stripped last
    (after decoding, so encoded tags vanish too)."""
    src = plain
    if html_col is not None:
        src = F.when((F.coalesce(plain, F.lit("")) == "") & html_col.isNotNull(),
                     html_to_text(html_col)).otherwise(F.coalesce(plain, F.lit("")))
    return strip_tags(normalize_whitespace(strip_quoted_replies(src)))


def embedding_text(subject: Column, body: Column) -> Column:
    """trim(subject + ' ' + body) with nulls as ''."""
    return php_trim(F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


def selected_headers(headers: Column, names: list[str]) -> Column:
    """F8: keep only the named headers with a non-empty value."""
    wanted = F.array(*[F.lit(n.lower()) for n in names])
    return F.map_filter(headers, lambda k, v: F.array_contains(wanted, F.lower(k)) & (F.coalesce(v, F.lit("")) != ""))

