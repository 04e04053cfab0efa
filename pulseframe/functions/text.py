"""Text keys, normalisation and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode text tools see it, including the separator controls.
_SPACE = r"(?U)[\s\x1c-\x1f]"


def is_blank(text: Column) -> Column:
    """True for null or whitespace-only text."""
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE + "+", " "))


def normalise_text(text: Column) -> Column:
    """B2: URLs become a space, whitespace collapses, ends are trimmed."""
    return collapse_spaces(F.regexp_replace(text, r"(?U)https?://[^\s\x1c-\x1f]+", " "))


def casefold(text: Column) -> Column:
    """Lower case plus the folds that lower-casing alone leaves apart."""
    folded = F.lower(text)
    for source, target in (("ß", "ss"), ("ς", "σ"), ("ſ", "s")):
        folded = F.replace(folded, F.lit(source), F.lit(target))
    return folded


def text_key(text: Column) -> Column:
    """Content key used to match rows by text."""
    return casefold(collapse_spaces(F.coalesce(text, F.lit(""))))


def text_id(text: Column) -> Column:
    """I8: short stable id of a text's content."""
    return F.substring(F.sha1(text_key(text)), 1, 12)


def slug(name: Column, empty: str = "event") -> Column:
    """I4: lower snake case of ASCII letters and digits."""
    body = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")
    trimmed = F.regexp_replace(body, "^_+|_+$", "")
    return F.when(trimmed == "", F.lit(empty)).otherwise(trimmed)


def word_count(text: Column) -> Column:
    collapsed = collapse_spaces(F.coalesce(text, F.lit("")))
    return F.when(collapsed == "", F.lit(0)).otherwise(F.size(F.split(collapsed, " ")))


def length_bucket(text: Column) -> Column:
    """Short / medium / long by word count."""
    words = word_count(text)
    return (
        F.when(words <= 8, "short (<=8 words)")
        .when(words <= 25, "medium (9-25 words)")
        .otherwise("long (>25 words)")
    )


def group_from_permalink(permalink: Column, source: Column) -> Column:
    """Discussion id taken from a video or thread link; null when there is none."""
    video = F.regexp_extract(permalink, r"[?&]v=([\w-]{6,})", 1)
    thread = F.regexp_extract(permalink, r"/comments/([a-z0-9]+)", 1)
    is_video = (
        (source == "youtube") | permalink.contains("youtube.com") | permalink.contains("youtu.be")
    )
    is_thread = (source == "reddit") | permalink.contains("reddit.com")
    return F.when(is_video & (video != ""), F.concat(F.lit("yt:"), video)).when(
        is_thread & (thread != ""), F.concat(F.lit("rd:"), thread)
    )


def pool_group_key(parent: Column, source: Column) -> Column:
    """Bare parent ids get their platform prefix."""
    return (
        F.when(parent.isNull() | parent.contains(":"), parent)
        .when(source == "youtube", F.concat(F.lit("yt:"), parent))
        .when(source == "reddit", F.concat(F.lit("rd:"), parent))
        .otherwise(parent)
    )


def video_permalink(video_id: Column, comment_id: Column) -> Column:
    """Link to one comment below a video."""
    return F.concat(
        F.lit("https://www.youtube.com/watch?v="), video_id, F.lit("&lc="), comment_id
    )


def thread_permalink(link: Column) -> Column:
    """Absolute link of a thread or comment; absolute and empty links stay as they are."""
    relative = (link != "") & ~link.startswith("http")
    return F.when(relative, F.concat(F.lit("https://reddit.com"), link)).otherwise(link)
