"""Column expressions over text. All native, so they stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from trendgap.config import UNKNOWN_BRAND, BrandConfig

# The characters Python's str.strip() removes. Spark's trim removes
# the blank only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Letters, numbers and underscore of any script; combining marks end a tag.
TAG_PATTERN = r"#([\p{L}\p{N}_]+)"

FENCE = "```"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def first_filled(*options: Column | str) -> Column:
    """First option that is neither NULL nor empty; the last one is the default."""
    *tried, default = [o if isinstance(o, Column) else F.lit(o) for o in options]
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in tried], default)


def clean_tags(tags: Column) -> Column:
    """Drop NULL and empty entries, give every other exactly one leading '#'."""
    return F.transform(
        F.filter(tags, lambda t: t != ""),
        lambda t: F.concat(F.lit("#"), F.ltrim(t, F.lit("#"))),
    )


def extract_tags(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(TAG_PATTERN), F.lit(1))
    return F.transform(found, lambda t: F.concat(F.lit("#"), t))


def choose_tags(text: Column, given: Column, distinct: bool, limit: int) -> Column:
    """Given tags if there are any, else those written in the text.

    With `distinct`, the rule of stored posts, the *given* list decides (a list of
    blanks yields no tags). Without, the rule of feed posts, the *cleaned* list decides.
    """
    cleaned = clean_tags(given)
    deciding = given if distinct else cleaned
    tags = F.when(F.size(F.coalesce(deciding, F.array())) > 0, cleaned).otherwise(
        extract_tags(F.coalesce(text, F.lit("")))
    )
    if distinct:
        tags = F.array_distinct(tags)
    return F.slice(tags, 1, limit)


def config_tags(tags: Column) -> Column:
    """Tags typed into a brand form: trimmed, one '#' at most, first spelling kept."""
    bare = F.transform(tags, lambda t: F.regexp_replace(strip(t), "^#", ""))
    return F.array_distinct(
        F.transform(F.filter(bare, lambda t: t != ""), lambda t: F.concat(F.lit("#"), t))
    )


def search_tags(tags: Column) -> Column:
    """Tags as a search wants them: without any leading '#'."""
    return F.transform(tags, lambda t: F.ltrim(t, F.lit("#")))


def competitor_names(tags: Column) -> Column:
    """Competitors are typed as tags; each loses its first '#'."""
    return F.transform(tags, lambda t: F.regexp_replace(t, "^([^#]*)#", "$1"))


def lowered(*texts: Column) -> Column:
    """Texts joined by blanks, in lower case; NULL counts as empty.

    Keep the result as a column of its own where several tests use it: tests behind an
    `or` or a `when` would each convert the text again.
    """
    return F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))


def contains_any(names: Iterable[str], *lower_texts: Column) -> Column:
    """True if any name occurs, ignoring case, inside any of the lower-case texts."""
    tests = [F.contains(t, F.lit(n.lower())) for n in names for t in lower_texts]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def first_brand(brand: BrandConfig, lower_text: Column) -> Column:
    """First known brand in the lower-case text, competitors before our own.

    A substring test: 'plum' is found in 'plump'.
    """
    known = {name.lower(): name for name in (*brand.competitors, brand.name)}
    found = F.lit(UNKNOWN_BRAND)
    for key, name in reversed(known.items()):
        found = F.when(F.contains(lower_text, F.lit(key)), F.lit(name)).otherwise(found)
    return found


def lexicon_hits(text: Column, words: Iterable[str]) -> Column:
    """Number of distinct lexicon words occurring in the text as substrings."""
    lower_text = F.lower(text)
    hits = [F.contains(lower_text, F.lit(w)).cast("int") for w in dict.fromkeys(words)]
    return F.coalesce(reduce(lambda a, b: a + b, hits, F.lit(0)), F.lit(0))


def sentiment(text: Column, words: Iterable[str], step: float, cap: float) -> Column:
    return F.least(lexicon_hits(text, words) * F.lit(step), F.lit(cap))


def strip_fences(text: Column) -> Column:
    """Content of a reply that may be wrapped in a Markdown code fence."""
    body = strip(text)
    inner = F.split_part(body, F.lit(FENCE), F.lit(2))
    unlabelled = F.when(F.startswith(inner, F.lit("json")), F.substring(inner, 5, 2**31 - 1))
    return F.when(
        F.startswith(body, F.lit(FENCE)), strip(F.coalesce(unlabelled, inner))
    ).otherwise(body)


def video_prompt(image_prompt: Column, brand: BrandConfig | None = None) -> Column:
    """Prompt for the video model; with a brand, the longer form that names it."""
    # The wording the video service is given.
    plain = (
        "Vertical 9:16 format for Instagram Reels. "
        "Cinematic quality. No text overlay. Smooth motion. 6 seconds."
    )
    branded = (
        "Vertical 9:16 format for Instagram Reels. Cinematic quality. "
        "Smooth motion. No text overlay. 6 seconds."
    )
    prompt = F.coalesce(image_prompt, F.lit(""))
    if brand is None:
        return F.concat(prompt, F.lit(f". {plain}"))
    return F.concat(prompt, F.lit(f". Brand: {brand.name}. Tone: {brand.tone}. {branded}"))


def reel_file_name(brand: Column) -> Column:
    return F.concat(F.lower(F.replace(brand, F.lit(" "), F.lit("_"))), F.lit("_reel.mp4"))


def post_text(caption: Column, tags: Column) -> Column:
    """Text ready to paste: caption, blank line, tags."""
    return F.concat(
        F.coalesce(caption, F.lit("")),
        F.lit("\n\n"),
        F.array_join(F.coalesce(tags, F.array()), " "),
    )
