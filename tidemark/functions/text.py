"""Text cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six entities, decoded in this order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
# Scripts and styles with their content, tags, and the control characters that go.
HIDDEN = r"(?is)<(script|style)[^>]*>.*?</\1>"
TAG = r"<[^>]+>"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
MAX_CHARS = 2000
PREPROCESSED_CHARS = 512 * 3
#: Unicode white space, and the separators \x1c-\x1f that Java's class leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def clean_html(text: Column) -> Column:
    """Text without scripts, styles and tags, with six entities decoded; null and empty give ""."""
    out = F.regexp_replace(text, HIDDEN, "")
    out = F.regexp_replace(out, TAG, "")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.coalesce(out, F.lit(""))


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def remove_control_chars(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, "")


def clean_text(text: Column) -> Column:
    """HTML, then white space, then control characters; not idempotent, as decoded tags go only the next time."""
    return remove_control_chars(normalize_whitespace(clean_html(text)))


def truncate(text: Column, most: int = MAX_CHARS) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def preprocess(full_text: Column, title: Column) -> Column:
    """The body, or else the title, cleaned and cut for the model."""
    return truncate(clean_text(F.coalesce(F.nullif(full_text, F.lit("")), title)), PREPROCESSED_CHARS)


def preprocess_title_and_body(title: Column, body: Column) -> Column:
    return truncate(F.concat(clean_text(title), F.lit("\n"), clean_text(body)), PREPROCESSED_CHARS)


def short_code(code: Column) -> Column:
    """A stock code without its exchange suffix."""
    return F.replace(F.replace(code, F.lit(".SH"), F.lit("")), F.lit(".SZ"), F.lit(""))
