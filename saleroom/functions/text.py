"""Column expressions for the text, URL, price and date rules. All built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space a JavaScript trim removes.
JS_SPACE = (
    "[\\t\\n\\u000b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
)
# HTML entities, replaced in this order.
HTML_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
PREVIEW_CHARS = 200
TRACKING_URL = "https://tools.usps.com/go/TrackConfirmAction?tLabels="


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def trimmed_end(text: Column) -> Column:
    return F.regexp_replace(text, f"{JS_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """NULL, empty or white space only."""
    return F.coalesce(trimmed(text), F.lit("")) == ""


def preview(text: Column, limit: int = PREVIEW_CHARS) -> Column:
    """The whole text, or its first `limit` characters right-trimmed plus an ellipsis."""
    text = F.coalesce(text, F.lit(""))
    cut = F.concat(trimmed_end(F.substring(text, 1, limit)), F.lit("…"))
    return F.when(F.char_length(text) > limit, cut).otherwise(text)


def escape_html(text: Column) -> Column:
    for raw, entity in HTML_ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def line_breaks(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|\r|\n", "<br />")


def html_body(text: Column) -> Column:
    """Plain text as an HTML fragment: escaped, with line breaks."""
    return line_breaks(escape_html(F.coalesce(text, F.lit(""))))


def fill(template: str, values: dict[str, Column]) -> Column:
    """Put values into `{{name}}` slots; each slot occurs once, NULL becomes ''.

    Built by concatenating the literal pieces, so a value that itself contains a
    slot name is never filled again.
    """
    pieces: list[Column] = []
    rest = template
    slots = sorted(
        ((rest.find("{{" + name + "}}"), name) for name in values if "{{" + name + "}}" in rest)
    )
    position = 0
    for start, name in slots:
        pieces.append(F.lit(template[position:start]))
        pieces.append(F.coalesce(values[name].cast("string"), F.lit("")))
        position = start + len(name) + 4
    pieces.append(F.lit(template[position:]))
    return F.concat(*pieces)


def url_key(url: Column) -> Column:
    """The path of a URL without its leading slash; NULL when it cannot be parsed."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/", "")


def url_tail(url: Column) -> Column:
    """The text after the last slash."""
    return F.substring_index(url, "/", -1)


def percent_encoded(text: Column) -> Column:
    """Percent-encoding that leaves `A-Z a-z 0-9 - _ . ! ~ * ' ( )` alone."""
    encoded = F.url_encode(text)
    for form, plain in [
        ("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"),
    ]:
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    return encoded


def tracking_link(number: Column) -> Column:
    return F.concat(F.lit(TRACKING_URL), percent_encoded(number))


def price_number(price: Column) -> Column:
    """The numeric prefix of a text price as a decimal, NULL when it has none.

    White space of any script may come first; an exponent counts.
    """
    blank = r"^[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*"
    digits = F.regexp_extract(price, blank + r"([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1)
    return digits.try_cast("decimal(18,4)")


def us_date(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy")


def is_digits(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]+$"), F.lit(False))


def truthy(value: Column) -> Column:
    """A number, or a text that reads as one, which is neither missing nor zero."""
    return F.coalesce(value.try_cast("decimal(38,10)") != 0, F.lit(False))
