"""Text helpers: HTML cleaning, link extraction, display strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from storelens.schemas import NOT_AVAILABLE, NOT_SPECIFIED, TRANSCRIPT_PREFIX

# Fixed values (must match the reference's text cleaning):
# - WHITESPACE_CLASS: the characters Python's str.isspace() accepts, i.e. what
#   the reference's `\s` matches on text (Java's plain `\s` misses several);
# - TAG_PATTERN: an HTML tag, replaced by a space;
# - HREF_PATTERN: default link pattern for extract_links (group 1 = target).
WHITESPACE_CLASS = (r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}"
                    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
TAG_PATTERN = r"<[^>]+>"
HREF_PATTERN = r'href="([^"]+)"'


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_html(c) -> Column:
    """Tags become a space, whitespace runs collapse to one space, ends trimmed.

    NULL and '' give ''.  Text inside <script>/<style> is kept and entities are
    not decoded, as in the reference.
    """
    text = F.coalesce(_col(c), F.lit(""))
    text = F.regexp_replace(text, TAG_PATTERN, " ")
    text = F.regexp_replace(text, WHITESPACE_CLASS, " ")
    # After the collapse the only whitespace left is ' ', so trim() is a full strip.
    return F.trim(text)


def extract_links(c, pattern: str = HREF_PATTERN, group: int = 1) -> Column:
    """Distinct regex matches of ``pattern`` (group ``group``) as an array."""
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group)))


def money(c) -> Column:
    """Two decimals, rounded like Python/C printf (half-even on the exact binary
    value).  Java's %.2f rounds the shortest decimal form half-up instead
    (1.005 -> 1.01), so format_number (DecimalFormat) is used, without grouping."""
    return F.regexp_replace(F.format_number(_col(c).cast("double"), 2), ",", "")


def format_price(lo, hi) -> Column:
    """'$a' when max is absent or equal, else '$a - $b' (two decimals)."""
    lo, hi = _col(lo), _col(hi)
    single = F.concat(F.lit("$"), money(lo))
    return (F.when(lo.isNull(), F.lit(None).cast("string"))
             .when(hi.isNull() | (hi == lo), single)
             .otherwise(F.concat(F.lit("$"), money(lo), F.lit(" - $"), money(hi))))


def transcript_line(role, text) -> Column:
    """'USER: text' / 'CHATBOT: text' followed by a newline; other roles NULL."""
    role, text = _col(role), _col(text)
    prefix = F.when(role == "user", F.lit(TRANSCRIPT_PREFIX["user"])) \
              .when(role == "assistant", F.lit(TRANSCRIPT_PREFIX["assistant"]))
    return F.concat(prefix, F.coalesce(text, F.lit("")), F.lit("\n"))


def fact_sheet(title, vendor, lo, hi, has_discount, tags) -> Column:
    """Product fact block used to answer product questions.

    Tags are a comma text; they are split and re-joined so each tag is listed
    once rather than character by character.
    """
    price = F.coalesce(format_price(lo, hi), F.lit(NOT_AVAILABLE))
    tag_list = F.array_join(F.split(F.coalesce(_col(tags), F.lit("")), r",\s*"), ", ")
    tag_text = F.when(F.length(F.trim(F.coalesce(_col(tags), F.lit("")))) == 0,
                      F.lit(NOT_SPECIFIED)).otherwise(tag_list)
    on_sale = F.when(F.coalesce(_col(has_discount), F.lit(False)), F.lit("Yes")).otherwise(F.lit("No"))
    return F.concat(
        F.lit("Name: "), F.coalesce(_col(title), F.lit(NOT_SPECIFIED)), F.lit("\n"),
        F.lit("Brand: "), F.coalesce(_col(vendor), F.lit(NOT_SPECIFIED)), F.lit("\n"),
        F.lit("Price Range: "), price, F.lit("\n"),
        F.lit("On Sale: "), on_sale, F.lit("\n"),
        F.lit("Tags: "), tag_text,
    )
